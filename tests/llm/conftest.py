import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def documents(spark):
    """A function: rows to a table of the documents' shape."""
    return lambda rows: spark.createDataFrame([r if len(r) == 5 else row(*r) for r in rows], SCHEMA).repartition(3)


LONG = "a line that is long enough to count\n" * 3 + "word " * 30_000

#: Null and empty texts, ties, repeated rows, a very long text, blanks only, non-ASCII text, a null id and a null source.
EDGES = [
    row(1, None), row(2, ""), row(3, "  \n\t\n"), row(4, LONG), row(5, "Über uns: élan 😀 ▁x"), row(5, "Über uns: élan 😀 ▁x"),
    row(6, "one two three four five six seven"), row(7, "one two three four five six seven"), (8, "no source", None, None, None), (None, "no id at all", "en", "b", 12), (None, None, None, None, None),
]
