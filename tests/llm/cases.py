"""Small tables with everything that may be wrong in one."""

TEXT = "doc_id long, text string, lang string, score double"
LONG = "The quick brown fox jumps over the lazy dog near the old river bank today . " * 3000

ODD = [
    (1, None, "en", None),
    (2, "", None, 1.0),
    (3, " \t\n ", "en", 1.0),
    (4, "one", "en", 1.0),
    (5, "one", "en", 1.0),
    (6, "o n e\n", "en", 1.0),
    (None, "a row without an id", "en", 1.0),
    (7, LONG, "en", 1.0),
    (8, "mixed ünïcode 😀 text with\nlines\nlines\n", "xx", None),
    (8, "mixed ünïcode 😀 text with\nlines\nlines\n", "xx", None),
]


def odd(spark):
    return spark.createDataFrame(ODD, TEXT)


def empty(spark):
    return spark.createDataFrame([], TEXT)


def clashing(spark):
    """Columns whose names operators use inside."""
    schema = "doc_id long, text string, fp long, digest string, spans string, kept string, rank string, n long, word string, length string, key string, __id long, __row string"
    return spark.createDataFrame([(1, "Call +1 (523) 555-1055 or mail a.b@c.org now", 1, "d", "s", "k", "r", 2, "w", "l", "y", 3, "z")], schema)
