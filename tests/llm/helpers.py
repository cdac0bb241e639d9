"""Small document tables with everything that operators must bear."""

LONG = " ".join(f"w{i % 97} x{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BASE = " ".join(f"base{i}" for i in range(120))


def odd_rows():
    """(doc_id, text, lang, source, n_chars, body, k1, score, row, digest): the last five names clash with the operators' own."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog"), (2, "The quick brown fox jumps over the lazy dog"), (3, None), (4, ""), (5, " \t\n "),
        (6, LONG), (7, BASE), (8, BASE + " tail words"), (8, BASE + " tail words"), (9, "one two " + PASSAGE + " three four"),
        (10, PASSAGE), (11, "Ünïcode ß 中文 😀 it's 12 34!"), (None, "The quick brown fox jumps over the lazy dog"), (None, None), (12, "a " * 100),
    ]
    return [(i, t, "en", "s", len(t or ""), f"b{n}", n, 0.5, "r", "d") for n, (i, t) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, k1 int, score double, row string, digest string"


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
