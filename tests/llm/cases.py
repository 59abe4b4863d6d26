"""Awkward tables every text operator has to take."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
WORDS = [f"word{n}" for n in range(400)]
LONG = " ".join(WORDS * 60)
PASSAGE = " ".join(f"pass{n}" for n in range(60))

#: doc_id, text and extra columns whose names operators use themselves.
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while.", "en", "s"),
    (2, "The cat sat on the mat  and\tlooked at the dog for a while.", "en", None),
    (2, "The cat sat on the mat  and\tlooked at the dog for a while.", "en", None),
    (3, "", None, "s"),
    (4, None, None, None),
    (5, " \t\n ", "en", "s"),
    (6, LONG, "en", "s"),
    (7, LONG, "en", "s"),
    (8, "x" * 50_000, "en", "s"),
    (9, "only four words here", "de", "s"),
    (10, "only four words here", "de", "s"),
    (11, f"start {PASSAGE} end", "en", "s"),
    (12, f"other {PASSAGE} close", "en", "s"),
    (13, "Ünïcödé ß words 中文 и другие 12345 ²", "de", "s"),
    (None, "a text without an id", "en", "s"),
    (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = (
    "score double, label int, stats int, text_of string, digest string, kept string, n long, "
    "band long, segment int, ids string, words string, length int, seed int, step string"
)


def documents(spark):
    """The rows above with extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    extra = [f.split() for f in EXTRA.split(", ")]
    return docs.withColumns({name: F.lit(None).cast(kind) for name, kind in extra})


def empty(spark):
    """No rows, the same columns."""
    return documents(spark).limit(0)
