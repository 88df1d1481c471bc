import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


#: Nulls in every column, empty and blank texts, ties, repeated rows, a long text.
ODD = [doc(None, None, None, None), doc(1, ""), doc(2, None), doc(3, " \t\n "), doc(4, "one"), doc(5, "one two three"), doc(5, "one two three"), doc(5, "another text of this id"),
       doc(6, "word " * 20_000, None), doc(7, "Éa \U0001f600 naïve"), doc(None, "no id here at all"), doc(None, "no id here at all"), doc(-3, "one two three", "b")]


@pytest.fixture(scope="session")
def odd(spark):
    """``documents`` with odd rows and further columns of clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("rank", "label", "_hash", "key", "size", "line", "fp", "node", "value", "n"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
