import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size string, slot string, kept string, _text string, _id string, copies string, sketch string"
)
LONG = " ".join(f"word{i % 977}x" for i in range(30_000)) + "\n" + "x" * 50_000


def edge_rows():
    extra = ("a",) * 7
    common = "one two three four five six seven eight nine ten eleven twelve. " * 3
    texts = [
        (1, common, "b"), (1, common, "b"), (1, common + "more", None), (2, None, None), (3, "", "é"),
        (4, " \t\r\n\x0b\f", "Z"), (5, LONG, "b"), (None, common, "b"), (None, None, None), (6, "😀 ü x " * 40, ""),
        (7, LONG, "b"), (8, "a b", "é"),
    ]
    return [(d, t, "en", s, None, *extra) for d, t, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
