"""Rows that every text operator has to bear, and a clash of column names."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "ONE two THREE four five six seven"),
    (None, "one two three four five six seven"),
    (None, None),
    (6, "ñandú 漢字 😀 don't 12³ !!"),
    (7, LONG),
    (8, "x"),
]


def texts(spark, rows=TEXTS):
    """Documents with columns named like those the operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = ("score", "predicted", "n_tokens", "key", "id", "component_id", "pii_count", "ids", "n", "block")
    return df.withColumns({name: F.lit("clash") for name in clash})


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
