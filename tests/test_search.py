"""Rankings of the search queries where more scores tie after rounding than a query returns."""

import pytest

from noteloom.plans import queries as base


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Texts and vectors that tie when rounded to 6 places; unrounded, those of the smallest ids are a little worse."""
    d = str(tmp_path_factory.mktemp("tied"))
    spark.createDataFrame([(i, "word" + " x" * (5001 if i <= 60 else 5000)) for i in range(1, 201)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000, "word")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, 1e-4 if i <= 60 else 0.0]) for i in range(1, 201)] + [(1000, [1.0, 0.0])], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["bm25_search", "vector_topk", "hybrid_search"])
def test_ties_go_to_the_smallest_ids(spark, tied, name):
    got = base.QUERIES[name](spark, tied).filter("q_id = 1000").orderBy("rank").collect()
    assert [r.id for r in got] == list(range(1, 9)) and len({r.score for r in got}) == 1
