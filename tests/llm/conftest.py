"""Documents with the edge cases that every operator has to take."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] + str(x >> 20 & 63))
    return " ".join(out)


def rows():
    a = prose(120, 1)
    return [
        (0, a, "en", "s1", 1, 5),
        (1, a, "en", "s1", 1, 5),  # an exact copy
        (1, a, "en", "s1", 1, 5),  # a repeated row
        (2, None, None, None, None, None),
        (3, "", "en", "s2", 0, 1),
        (4, " \t\n", "de", "s2", 3, 1),
        (5, "one", "en", "s1", 3, 1),
        (6, prose(20_000, 2), "en", None, 1, 1),  # very long
        (7, a.replace(a.split()[60], "other", 1), "en", "s3", 1, 1),  # a near copy
        (8, "same same same same " * 30, "fr", "s3", 1, 1),
        (None, prose(60, 3), "en", "s1", 1, 1),
        (10, "übermäßig ÄÖ ü <|endoftext|> " + prose(70, 4), "de", "s2", 1, 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"


@pytest.fixture(scope="session")
def docs(spark):
    """n is a column that operators use within."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """A folder with the documents and labels as tables."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"file://{path}/documents.parquet")
    docs.sparkSession.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="session")
def empty_folder(empty, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    empty.write.parquet(f"file://{path}/documents.parquet")
    empty.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    empty.sparkSession.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{path}/pages.parquet")
    return f"file://{path}"
