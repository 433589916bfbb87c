import zlib

import pytest
from pyspark.sql import types as T



@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use inside.
CLASHING = "key row h p t n id mark fp rep digest salt token part block shard slot words size crc src kept node a b u v best".split()


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text, lang, source), with columns whose names clash with those used inside."""

    def make(rows, clash=True):
        full = [(*r, None, None)[:2] + ((r[2], r[3]) if len(r) > 3 else ("en", "s0")) + (len(r[1] or ""),) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    body = " ".join(words[(i * 7 + i // 3) % 8] + str(i % 13) for i in range(40))
    very_long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, body, "en", "a"),
        (2, body, "en", "a"),
        (2, body, "en", "a"),
        (None, body, None, None),
        (None, None, None, None),
        (3, None, "en", None),
        (4, "", "de", "b"),
        (5, " \n\t ", "de", "b"),
        (6, very_long, "fr", "c"),
        (7, "one", "fr", "c"),
        (8, "1234 !!! 😀", "fr", "ü"),
        (9, "Straße İ ſ \u0000 \U0001f600 naïve", "de", "ü"),
        (9, "another text under the same id", "de", "ü"),
    ]


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
