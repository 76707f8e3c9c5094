"""The registered queries beside their SQL, and the stages of the pipeline."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from check import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from tabulon.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert compare(got, connect(SF).execute(ORACLES[name]).df()) is None
    else:
        assert len(got)


def test_stages(spark, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        rows = out.count()
        if name != "best-fit packing":
            assert out.columns == awkward.columns and rows <= awkward.count()
        assert stage(spark, nothing, SF).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    got = corpus_pipeline.run(spark, SF)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*fields).collect())) == sorted(map(tuple, step.select(*fields).collect()))
    assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in docs.collect()}
