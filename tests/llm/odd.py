"""Documents with every kind of odd row, and extra columns whose names operators use inside."""

LONG = "Ein sehr langer Text, der kein Ende nimmt und sich doch nie wiederholt: " + " ".join(f"wort{i} satz{i % 7}." for i in range(6000))
PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly box.\n"
    "Nothing here repeats and every line of this short text ends with a point.\n"
    "Several more words follow so that rules on length do not reject it at once, for it has to reach over fifty words "
    "in total to pass the fixed base rules that every text must meet first, and now it does so with ease."
)
DOCS = [
    (1, PROSE, "en", "s1", 10),
    (2, PROSE, "en", "s2", 10),
    (2, PROSE, "en", "s2", 10),
    (3, None, "en", "s3", None),
    (4, "", None, None, 0),
    (5, LONG, "de", "s1", len(LONG)),
    (6, "   \n\t \n", "de", "s4", 6),
    (None, "No id but words: secret = abcdef0123456789abcdef", "en", "s5", 5),
    (7, "word", None, "s1", 4),
    (8, PROSE.upper(), "en", None, 1),
    (9, "x" * 5000, "en", "s2", 5000),
]
EMPTY: list = []
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["c0", "own_text", "kept0", "zone", "node", "wide", "removed", "fp", "part", "stratum", "score", "host"]


def docs_frame(spark, rows=None):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
