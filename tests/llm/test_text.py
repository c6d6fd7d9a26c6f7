"""Decontamination, byte-level BPE, sharding."""

import base64
import gc
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken

from lodestar.llm import bpe, decontaminate, shard

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def items(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id long, text string, doc_id string")


def brute(rows, tests, size=10):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = lambda t: find("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    owners = {}
    for i, t in tests:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(o) for o in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    found |= owners[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def test_decontaminate(spark, documents):
    r = random.Random(2)
    word = lambda: r.choice(["The", "of", "naïve", "x1", "Straße", "a", "b"])
    tests = [(i, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 14])))) for i in range(12)]
    tests += [(3, "more of it " * 5), (40, None), (41, "..."), (None, "lone words here")]
    rows = [(i, ", ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(None, "the of"), (70, None), (71, ""), (72, "!!"), (73, tests[4][1].upper() + " tail " * 3000), (73, "x")]
    for size in (8 << 20, 40):  # one machine; some twenty
        out = decontaminate.decontaminate(documents(rows), items(spark, tests), machine_bytes=size)
        assert Counter(map(tuple, out.collect())) == brute(rows, tests)
    none = decontaminate.decontaminate(documents(rows), items(spark, tests).limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.decontaminate(documents([]), items(spark, tests)).collect() == []
    for size in (8 << 20, 10):
        tests = items(spark, [(1, "tail tail tail"), (2, "the words of nobody"), (3, "nothing else")])
        kept = decontaminate.clean_documents(documents(rows), tests, machine_bytes=size)
        assert Counter(x["doc_id"] for x in kept.collect()) == Counter(i for i, t in rows if "tail" not in (t or ""))
        assert kept.columns == documents(rows).columns


def test_benchmark_blocks(spark):
    tests = items(spark, [(i, f"item {i} " * 20) for i in range(100)])
    blocks = list(decontaminate._blocks(tests, 1000))
    assert len(blocks) > 10 and sorted(i for b in blocks for i, _ in b) == sorted(str(i) for i in range(100))
    assert max(sum(len(t) for _, t in b) for b in blocks) < 4000


def test_wu_manber_shifts():
    machine = decontaminate.WuManber([list("abcde"), list("bcdef"), list("zzzzz")], 2)
    assert sorted(machine.find(list("xxabcdefzzzzzz"))) == [(2, 0), (3, 1), (8, 2), (9, 2)]
    assert list(machine.find([])) == []


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(documents):
    codec, other = bpe.codec(RANKS, public_tokenizers.PATTERN), reference()
    r = random.Random(1)
    alphabet = list("abcdefghijthe n") + list("éüñß日本語😀12.,!!\n\t aaAA")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["ab" * 3000, "a" * 5000, " " * 300, "é" * 999, "<|endoftext|>", "", "\x00\r\n"]
    for t in texts:
        ids = memoryview(codec.encode(t)).cast("I").tolist()
        assert ids == other.encode_ordinary(t)
        assert codec.decode_bytes(codec.encode(t)).decode() == t == "".join(codec.decode_stream(ids, 3))
    rows = [(1, "hello wörld"), (2, None), (2, ""), (None, "x")]
    out = bpe.digests(documents(rows), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, out)) == Counter(want)
    wide = bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN)
    assert {(r["decoded"], len(r["ids"])) for r in wide.collect()} == {(t or "", n) for (_, t), (_, n, _, _) in zip(rows, want, strict=True)}
    assert bpe.digests(documents([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_tokens_that_fit_by_undoing_merges():
    machine = bpe.MergeTransducer(bpe.read_ranks(RANKS))
    assert machine.in_order and len(machine.parts) > 50_000
    r = random.Random(2)
    tokens = sorted(machine.parts)
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(20_000)] + [(t, t) for t in r.sample(tokens, 2000)]
    words = [t for t in tokens if t.isalpha()]
    for _ in range(20_000):  # pieces of one token, which are often joined again
        t = r.choice(words)
        k = r.randint(0, len(t) - 1)
        pairs += [(t[:k], t[k:])] if k and t[:k] in machine.parts and t[k:] in machine.parts else []
    found = [machine._apart(a, b) for a, b in pairs]
    assert found == [machine.merged(a + b) == [a, b] for a, b in pairs] and 0 < sum(found) < len(found)


def test_transducer_starts_afresh():
    small = bpe.MergeTransducer(bpe.read_ranks(RANKS), max_states=50)
    other = reference()
    for w in ("internationalisation", "Donaudampfschiff", "incomprehensibilities", "aaaaaaaaaaaaaaaaaaaaab") * 3:
        assert memoryview(small.encode(w.encode())).cast("I").tolist() == other.encode_ordinary(w)


def test_a_codec_holds_no_more_than_its_bounds():
    codec, other = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, max_pieces=40), reference()
    r = random.Random(3)
    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, bpe._State) for x in gc.get_objects())
        for _ in range(2000):
            text = "".join(r.choice("aeinrst") for _ in range(20)) + " the"
            assert memoryview(codec.encode(text)).cast("I").tolist() == other.encode_ordinary(text)
        left = sum(isinstance(x, bpe._State) for x in gc.get_objects()) - before
    finally:
        gc.enable()
    assert left < 200 and len(codec.pieces) <= 40 and len(codec.pieces.older) <= 40


def test_utf8_stream():
    data = "aé日😀\U0010ffffz".encode() + b"\xff\xc3(\xe2\x82\xed\xa0\x80\xf0\x9f" + "é".encode() + b"\xe2\x82"
    for cut in range(1, 6):
        stream = bpe.Utf8Stream()
        text = "".join(stream.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + stream.end()
        assert text == data.decode("utf-8", "replace")


def test_shards(documents):
    r = random.Random(4)
    rows = [(i, "t" * r.randint(0, 300)) for i in range(800)] + [(5, "same"), (5, "same"), (None, None), (900, ""), (901, "é" * 10)]
    out = shard.shard(documents(rows)).collect()
    assert len(out) == len(rows)
    by_size, slots = Counter(), {}
    where = {}
    for x in out:
        by_size[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
        assert where.setdefault((x["text_crc32"], x["size"]), x["shard"]) == x["shard"]
        assert x["law"] == "bytes" and x["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(by_size) == set(range(8))
    assert max(by_size.values()) - min(by_size.values()) <= 4
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == want
    assert shard.shard(documents([])).collect() == []


def test_shards_of_many_parts_with_a_heavy_group(documents, monkeypatch):
    monkeypatch.setattr(shard, "PART_GROUPS", 100)
    r = random.Random(5)
    for share in (0.1, 0.33):
        rows = [(i, f"{i} " + "t" * r.randint(0, 300)) for i in range(1000)]
        light = sum(len(t) + 1 for _, t in rows)
        copies = round(light * share / (1 - share) / 100)
        rows += [(1000 + i, "c" * 99) for i in range(copies)]
        sizes, where = Counter(), {}
        for x in shard.shard(documents(rows)).collect():
            sizes[x["shard"]] += x["size"]
            assert where.setdefault(x["text_crc32"], x["shard"]) == x["shard"]
        heavy = where[zlib.crc32(b"c" * 99)]
        if share > 1 / 8:
            assert sizes.pop(heavy) == copies * 100  # a shard to itself
        assert sum(sizes.values()) == light + copies * 100 * (share < 1 / 8)
        assert max(sizes.values()) - min(sizes.values()) <= 0.001 * light


def plain_differencing(sizes, k):
    """The shard of each size; partial partitions in a plain list."""
    parts = [(i, [(n, [i])] + [(0, [])] * (k - 1)) for i, n in enumerate(sizes)]
    fresh = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (min(b[0] for b in p[1]) - max(b[0] for b in p[1]), p[0]))
        (_, a), (_, b) = parts[:2]
        a, b = sorted(a, key=lambda x: -x[0]), sorted(b, key=lambda x: x[0])
        parts = [*parts[2:], (fresh, [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b, strict=True)])]
        fresh += 1
    return parts[0][1] if parts else []


def test_shards_against_plain_differencing(documents):
    r = random.Random(6)
    rows = [(i, r.choice("abc") * r.randint(0, 60)) for i in range(150)] + [(200 + i, "heavy" * 300) for i in range(4)]
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t) + 1
    sizes = sorted(groups.values(), reverse=True)
    for k in (2, 8):
        want = sorted(n for n, _ in plain_differencing(sizes, k))
        got = Counter({i: 0 for i in range(k)})
        for x in shard.shard(documents(rows), k).collect():
            got[x["shard"]] += x["size"]
        assert sorted(got.values()) == want
    numbers = [r.randint(1, 50) for _ in range(40)]
    for k in (2, 3, 8):
        bins = [b[0] for b in shard.differencing([[n] + [0] * (k - 1) for n in numbers], k)]
        sums = Counter({i: 0 for i in range(k)})
        for n, b in zip(numbers, bins, strict=True):
            sums[b] += n
        assert sorted(sums.values()) == sorted(n for n, _ in plain_differencing(numbers, k))


def test_differencing():
    numbers = [8, 7, 6, 5, 4]
    bins = [b[0] for b in shard.differencing([[n, 0] for n in numbers], 2)]
    sums = Counter()
    for n, b in zip(numbers, bins, strict=True):
        sums[b] += n
    assert sorted(sums.values()) == [14, 16]  # the known result of differencing
    assert shard.differencing([], 3) == []
