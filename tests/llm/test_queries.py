"""The registered operator queries and the pipeline on the smallest tables, against SQL where there is one."""

import os

import pytest

from evispan.llm import queries
from tests.conftest import SMALL
from tests.test_queries import duck, rows_of  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SMALL)
    got = rows_of(df.collect(), df.columns)
    assert got[0]
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name])
        assert got == rows_of(want.fetchall(), [d[0] for d in want.description])


def test_ten_queries():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11))


def test_held_out_quality(spark):
    found = queries.QUERIES["op7_byte_cnn"](spark, SMALL).where("held_out")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    both = found.join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in both) >= 0.9 * len(both)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= now.count()
        now = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, SMALL).count() == now.count()
