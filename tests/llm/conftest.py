import pytest

#: Names that operators use inside, to clash with.
CLASHING = ("node", "label", "sig", "n", "h", "key", "spans", "doc", "size", "score", "shard", "a", "b")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties and clashing columns."""
    words = [f"word{i * 7919 % 613}" for i in range(400)]
    long = " ".join(words[i * 31 % 400] for i in range(30_000))
    twice = " ".join(words[:80])
    texts = [(1, ""), (2, None), (3, " \n\t "), (4, "one"), (5, long), (6, twice), (7, twice), (7, twice), (None, twice), (8, "x" * 5000), (9, "É ß 中文   😀 a"), (10, "\n".join(["same line here"] * 40)), (None, None)]
    rows = [(i, t, "en" if i else None, None if i == 4 else "s", None) + (1,) * len(CLASHING) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
