import pytest

from tallyloom.llm.store import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, keep boolean, fp long, shard int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


def documents(spark, texts, first=0):
    """Documents with extra columns named like columns that operators use inside."""
    rows = [(first + i, t, "en", "s", len(t or ""), "x", None, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def messy(spark):
    """Null and empty texts, a null id, ties, repeated rows, a very long text, odd white space."""
    texts = [None, "", " \n", "one", "the same words twice", "the same words twice", "A  b\tc\n" * 50_000, "é à 漢字 \U0001f600 ñ"]
    rows = documents(spark, texts)
    twice = documents(spark, ["the same words twice"], first=4)
    lost = rows.filter("doc_id = 3").selectExpr("cast(null as long) as doc_id", *rows.columns[1:])
    return rows.unionByName(twice).unionByName(lost).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")


@pytest.fixture(scope="session")
def corpus(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
