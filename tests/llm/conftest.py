import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use, too."""

    def made(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("score", "class", "key", "id", "words", "size", "features", "digest", "rid", "gone", "k0"):
                df = df.withColumn(name, F.lit("own"))
        return df

    return made


@pytest.fixture(scope="session")
def words():
    """Distinct invented words."""
    letters = "bcdfghklmnprstvz"
    return [a + v + b + w for a in letters for v in "aeiou" for b in letters for w in "ae"]
