import pytest

LONG = "Thou anon, the ererst. " * 40_000


@pytest.fixture(scope="session")
def rough(spark):
    """Rows that operators must take: nulls, empty and long texts, ties, repeats, odd columns."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5), (2, None, "en", "a", 5),
        (3, "", None, None, 5), (4, " \t\n", "fr", "b", 5), (5, "Alpha  beta gamma delta\nepsilon zeta", "en", "b", 5),
        (6, "ALPHA beta gamma delta epsilon zeta", None, "b", 5), (None, "Ohne Nummer, aber mit Text", "de", "c", 5),
        (8, LONG, "en", "b", 5), (9, "Ohne Nummer, aber mit Text", "de", None, 5), (9, "Ohne Nummer, aber mit Text", "de", None, 5),
        (10, "1234 5678 +++ ---", "en", "a", 5), (11, "é́ ǅ ＡＢＣ \U0001F600 \x1c  ſecret", "fr", "é", 5),
        (12, "one", "en", "a", 5), (13, "one", "en", "z", 5)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("kept", "score", "size", "bucket", "number", "label", "print", "root", "line", "key", "words",
                  "__id", "__n", "__hash", "__kept", "__gone", "__copies", "__copy", "__lines", "node", "c1", "a.b"):
        df = df.selectExpr("*", f"'x' as `{extra}`")
    assert df.columns[:5] == names
    return df.cache()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture
def texts():
    def collect(df):
        return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    return collect
