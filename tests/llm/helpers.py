"""Small tables that every operator has to take: nulls, empty and long texts, ties, repeated rows, extra columns."""

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", "en", "s", 6),
    (4, "One two three four five six seven", "en", "s", 33),
    (5, "one TWO three four five six seven", "de", None, 33),
    (5, "one TWO three four five six seven", "de", None, 33),
    (None, "ein zwei drei vier", None, "s", 18),
    (6, "a b", "en", "s", 3),
    (7, "line one\nline two\nline three\n" * 400, "en", "s", 11600),
    (8, "é́ ſ K <|endoftext|>  x\r\n\x1c ▁ 漢字 😀", "fr", "s", 30),
    (9, "x" * 30000, "en", "s", 30000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns with names that operators may use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("id", "fp", "key", "sub", "n", "digest", "keep_id", "group_size", "kept", "component_id", "a", "b", "root", "rank", "score", "start", "length", "part", "line", "chunk", "hash", "spans", "value", "text_sha256", "toxic", "held_out", "tokens", "h", "_h", "_id", "row", "lines", "uid", "place", "found", "_toxicity", "_n", "gone", "all", "sizes", "words", "stops", "marks", "low", "high", "side", "slab", "dim", "tie", "bytes", "first", "wanted", "own", "_gone", "_", "c", "r", "x", "bands", "size", "shingles", "least", "keep", "keep_h", "ids", "seq", "segment", "n_ids", "start_", "doc", "count", "h2")})
