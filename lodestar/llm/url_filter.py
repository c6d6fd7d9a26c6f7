"""URL filtering by association rules.

Fixed rules (host suffix and path beginning, the longest wins) come first. Where none fits, rules mined from labels decide:
FP-growth over the tokens of labelled URLs and their label. Tokens that are in the same URLs are one token to it, so sets
that differ in such tokens only aren't told apart again and again. Antecedents of a few tokens that lead to ``block`` with
enough support and confidence are kept if no proper part of them does as well, and are matched by an inverted index.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, in_slices, written

#: A mined rule holds in this share of the labelled URLs at least, in so many at least, and is right this often.
MIN_SUPPORT, MIN_URLS, MIN_CONFIDENCE = 0.001, 5, 0.7
#: Tokens in a mined rule, at most.
MAX_TOKENS = 3
#: verdict, host, path. Fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BLOCK = "label=block"
_PART = re.compile(r"[^a-z0-9\x80-\U0010ffff]+")
_DOCUMENT = r"^[^:]*://[^/?#]*/[^/?#]+/([0-9]{1,18})"


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and the rest; empty without ``://``."""
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, x in enumerate(rest) if x in "/?#"), len(rest))
    host, rest = rest[:end], rest[end:]
    end = next((i for i, x in enumerate(rest) if x in "?#"), len(rest))
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    return lower, rest[:end], rest[end:]


def tokens(url: str | None) -> list[str]:
    """What a URL is made of: labels of the host and their parts, segments of the path, names of parameters."""
    host, path, rest = split_url(url)
    found = {f"host={x}" for x in host.split(".") if x}
    found |= {f"part={x}" for label in host.split(".") if "-" in label for x in label.split("-") if x}
    found |= {f"path={x}" for x in path.lower().split("/") if x and not x[:1].isdigit()}
    found |= {f"ends={path.rsplit('.', 1)[1]}"} if "." in path.rsplit("/", 1)[-1] else set()
    found |= {f"name={x.split('=')[0]}" for x in _PART.split(rest.lower()) if x and not x.isdigit()}
    return sorted(found)


class FixedRules:
    """Rules by host; a URL's host and its parent domains are looked up, the longest rule that fits wins."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host].append((path, verdict))

    def __call__(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = 0
        while at >= 0 and host:
            suffix = host[at:]
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    rule = suffix + start
                    if best is None or len(rule) > len(best[0]):
                        best = rule, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


class MinedRules:
    """Token sets under their rarest token (the one in the fewest rules). ``alias``: the token that stands for another."""

    def __init__(self, rules: list[tuple[str, ...]], alias: dict[str, str] | None = None):
        self.alias = alias or {}
        uses: dict[str, int] = defaultdict(int)
        for rule in rules:
            for token in rule:
                uses[token] += 1
        self.index: dict[str, list[frozenset]] = defaultdict(list)
        for rule in rules:
            self.index[min(rule, key=lambda t: (uses[t], t))].append(frozenset(rule))

    def __call__(self, found: list[str]) -> bool:
        have = {self.alias.get(t, t) for t in found}
        return any(rule <= have for t in have for rule in self.index.get(t, ()))


def pruned(confidence: dict[tuple[str, ...], float]) -> list[tuple[str, ...]]:
    """The rules (sorted token sets) of which no proper part is as sure."""

    def needed(rule: tuple[str, ...]) -> bool:
        parts = (p for k in range(1, len(rule)) for p in combinations(rule, k))
        return not any(confidence.get(p, -1.0) >= confidence[rule] for p in parts)

    return sorted(filter(needed, confidence), key=lambda r: (len(r), r))


def _standing_for(baskets: DataFrame, least: int) -> dict[str, str]:
    """For each token in ``least`` baskets or more, the first of those in the same baskets: they have equal counts and equal
    sums of three hashes of the baskets. So many tokens are no more than tokens a URL over the least support."""
    rows = baskets.select(F.explode("items").alias("token"), "url_key")
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(i), "url_key"), F.lit(1 << 31))).alias(f"s{i}") for i in range(3)]
    counted = rows.groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    alike = counted.groupBy("n", "s0", "s1", "s2").agg(F.min("token").alias("first"), F.collect_list("token").alias("tokens"))
    return {t: r["first"] for r in alike.select("first", "tokens").collect() for t in r["tokens"]}


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_urls: int = MIN_URLS,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
) -> MinedRules:
    """Rules from labelled(url, bad): sets of up to ``max_tokens`` tokens that lead to ``bad``. All labelled rows are mined, and
    every rule with the support and confidence is found. A URL of t tokens supports fewer than t**max_tokens sets, so the
    number of rules is bounded by that over the least support, whatever the number of rows."""

    def run(batches):
        for batch in batches:
            urls = [x.decode("utf-8", "replace") for x in binaries(batch.column(0))]
            items = pa.array([tokens(u) for u in urls], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([items, batch.column(1), batch.column(2)], ["items", "url_key", "bad"])

    source = labelled.select("url", F.xxhash64("url").alias("url_key"), "bad")
    baskets = written(source.mapInArrow(in_slices(run, 0), "items array<string>, url_key long, bad boolean"), "baskets")
    n = baskets.count()
    share = max(min_support, min_urls / n) if n else 2
    if share > 1:
        return MinedRules([])
    alias = _standing_for(baskets, math.ceil(share * n - 1e-9))

    def standing(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [sorted({alias[t] for t in items if t in alias}) + [BLOCK] * bool(bad) for items, bad in rows]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["items"])

    few = written(baskets.select("items", "bad").mapInArrow(standing, "items array<string>"), "few-tokens")
    sets = FPGrowth(itemsCol="items", minSupport=share).fit(few).freqItemsets.where(F.size("items") <= max_tokens + 1)
    sets = written(sets.select(F.array_sort(F.array_remove("items", BLOCK)).alias("rule"), F.array_contains("items", BLOCK).alias("bad"), "freq"), "sets")
    both = sets.where("bad AND size(rule) > 0").select("rule", F.col("freq").alias("n_bad"))
    sure = both.join(sets.where("NOT bad").select("rule", "freq"), "rule").withColumn("confidence", F.col("n_bad") / F.col("freq"))
    rules = sure.where(F.col("confidence") >= min_confidence).select("rule", "confidence").collect()
    return MinedRules(pruned({tuple(r["rule"]): r["confidence"] for r in rules}), alias)


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page shows the document whose number is the second segment of its path; it is bad if that document
    is labelled toxic or of low quality."""
    known = (
        labels.groupBy(F.col("doc_id").cast("long").alias("_doc"))
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select("_doc", (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    )
    shown = pages.select("url", F.expr(f"try_cast(regexp_extract(url, '{_DOCUMENT}', 1) as bigint)").alias("_shown"))
    return shown.join(known, F.col("_shown") == F.col("_doc")).select("url", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict.

    pages(page_id, url), labels(doc_id, quality, toxic); further columns are ignored. A row for each row of pages,
    repeated ones too. A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless a
    mined rule (there is none without tokens) fits. Urls of any length are judged whole. ``rule`` is the fixed rule's host
    and path, else null; of fixed rules of one length the first counts; without a fixed rule the verdict is ``block`` if a
    mined rule fits. Without labels, or if none is sure enough, there are no mined rules. Empty pages give no rows.
    """
    mined = mine(label_pages(pages, labels))
    fixed = FixedRules(rules)

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path, _ = split_url(url)
                rule = fixed(host, path)
                if rule:
                    rows.append((host, path, *rule))
                else:
                    rows.append((host, path, None, "block" if mined(tokens(url)) else "allow"))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.string()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "path", "rule", "verdict"])

    schema = "page_id long, host string, path string, rule string, verdict string"
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(in_slices(run, 1), schema)
