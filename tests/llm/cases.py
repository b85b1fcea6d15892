"""Documents that every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
LONG = "lorem ipsum dolor sit amet " * 4000


def rows():
    text = "This is a plain sentence of the usual kind, and here is another one for good measure."
    return [
        (1, text, "en", "a", 10, None, None),
        (2, text, "en", "a", 10, 0.5, True),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None),
        (5, "   \n\t ", None, "b", None, None, None),
        (6, "12345 !!! ???", "de", None, 13, None, None),
        (7, LONG, "la", "c", len(LONG), None, None),
        (7, LONG, "la", "c", len(LONG), None, None),
        (8, "x" * 30_000, None, "c", 30_000, None, None),
        (9, "Ein kurzer deutscher Satz, der nicht sehr viel sagt.", "de", "c", 52, None, None),
        (None, "No id here, but words enough to be counted as a text.", "en", "a", None, None, None),
        (10, "漢字 and émigré <|endoftext|> 🙂\r\nline two\n\nline four", "en", "z", 40, None, None),
    ]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)
