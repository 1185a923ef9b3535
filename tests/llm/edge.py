"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(40))


def rows():
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    return [
        (5, BASE, "en", "a", 1),
        (3, BASE.replace(" ", "\t \n", 3), "en", "a", 1),  # equal up to white space
        (9, BASE + " tail", "en", "a", 1),  # near
        (9, BASE + " tail", "en", "a", 1),  # a repeated row
        (1, "", None, "a", 0),
        (2, None, "en", None, None),
        (4, " \n", "de", "b", 2),
        (None, BASE, "en", "a", 1),
        (None, None, None, None, None),
        (7, long, "fr", "c", len(long)),
        (8, "one two", "fr", "c", 7),
        (10, "One TWO", "fr", "c", 7),
        (11, "été <|endoftext|> 中文 ́x don't 'LL", "fr", "c", 7),
    ]


def docs(spark, extra=True):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("digest", "keys", "node", "component", "ids", "length", "piece", "score", "shard", "slot", "size", "h", "row", "file")})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
