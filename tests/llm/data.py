"""Small tables with the awkward cases, for all tests of the corpus operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river and a stone of light in the morning with no wind over old hills that nobody had seen before".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("" if i % 9 else str((seed + i) % 10)) for i in range(n))


ROWS = [
    (1, prose(1, 60), "en", "a", 10),
    (2, prose(1, 60), "en", "a", 10),
    (2, prose(1, 60), "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t \x0b", "en", None, 4),
    (6, prose(3, 5000), "en", "b", None),
    (7, "one two", None, "b", 7),
    (None, "ünïcode – слова 漢字 " * 5, "xx", "b", 1),
    (9, "Line one here\nLine one here\n\n other LINE\nLine one here", "en", "c", 1),
    (10, "!!! ### $$$ %%% " * 20, "en", "c", 1),
    (11, "x" * 30_000, "en", "c", 1),
    (12, "a a a a a a a a a a a a", "en", "c", 1),
    (13, "😀 emoji 𝒳 text +1 (212) 555-0100, mail a.b@c-d.example.org; 10.0.0.255 or 300.1.1.1 and 4111 1111 1111 1111.", "en", "c", 1),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(spark):
    """More columns, with names that operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "fp", "component", "words", "lines", "spans", "n_words", "kept", "seq", "grp", "length", "__key", "__text", "__spans", "verdict", "h")
    return documents(spark).withColumns({n: F.lit(n) for n in names})
