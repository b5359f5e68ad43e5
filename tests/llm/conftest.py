import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use, or might; each column holds its own name.
CLASHING = ("_id", "_sha", "_key", "_text", "_source", "_local", "_bin", "id", "place", "_place", "digest", "norm", "best", "salt", "hash", "part", "row", "key", "kept", "component_id", "lang_pred", "score", "c0", "slot")


@pytest.fixture(scope="session")
def clashing():
    return CLASHING


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows."""
    return [
        (1, "Hello wide world, hello again"), (2, "Hello  wide world,\nhello again"), (3, None), (4, ""), (5, " \t\n"), (6, "x" * 3000), (7, "word " * 40_000), (8, "日本語 😀 é Σς İ"),
        (9, "Hello wide world, hello again"), (9, "Hello wide world, hello again"), (None, "no id here"), (10, "12345 !!! ..."), (11, "a\x1cb\x85c\xa0d <|endoftext|> e"), (12, "Ab aB AB"),
    ]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """As a table, with columns whose names operators use themselves."""
    from maskspark.llm.common import new_path

    rows = [(i, t, "en" if i else None, "s", 0, 7, "x", 3, *CLASHING) for i, t in awkward]
    path = new_path(spark, "test-documents")
    spark.createDataFrame(rows, f"{DOCUMENTS}, n_tokens int, ids string, shard int, " + ", ".join(f"{c} string" for c in CLASHING)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -1")
