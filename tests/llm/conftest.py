import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text, and columns whose names the operators might use themselves."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, h string, uid int, rejected_id string"
        )

    return make
