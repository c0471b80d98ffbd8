import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bands string, digest string, name string, block string, _file string, _row string, _metadata string, held_out string, rejected string"
LONG = "the very long text goes on and on with words \n" * 20_000
ROWS = [
    (1, "You idiot, the cat sat on the mat and looked at the moon all night long", "en", "a"),
    (2, "you idiot,  the cat\tsat on the mat and looked at the moon all night long", "en", "a"),
    (3, "You idiot, the cat\tsat on  the mat and looked at the moon all night long", None, None),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, LONG, "en", "a"),
    (7, LONG, "en", None),
    (None, "no identifier here, a text of its own about rivers and hills", "en", "a"),
    (9, "der Hund lief durch den Wald und der Baum fiel um und lag da", "de", "b"),
    (9, "der Hund lief durch den Wald und der Baum fiel um und lag da", "de", "b"),
    (10, " \n\t ", "de", "b"),
    (11, "!!! 123 ???", "en", "a"),
    (12, "der Hund lief", "de", "b"),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, copies, repeated rows, and columns with names that the operators use inside."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(i, t, lang, src, None if t is None else len(t), *["x"] * 10) for i, t, lang, src in ROWS]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """An empty table."""
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
