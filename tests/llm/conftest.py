import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names clash with results'."""

    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, "x", 1.5) for r in rows]
        names = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, ids string, score double"
        return spark.createDataFrame(full, names).repartition(parts)

    return build


@pytest.fixture(scope="session")
def vectors_of(spark):
    def build(rows, parts=3):
        return spark.createDataFrame([(i, v, 0, "x", 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, id string, score double").repartition(parts)

    return build
