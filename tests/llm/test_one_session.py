"""Queries of both parts in one session: a comparator run leaves observers behind that no task can carry."""

import corpus_pipeline
from tablecheck.llm.queries import QUERIES
from tablecheck.plans import QUERIES as OTHERS

SF = "/root/testdata/sf0.001"


def test_secret_scan_and_pipeline_after_a_comparator_query(spark):
    assert OTHERS["column_match"](spark, SF).count() > 0
    found = QUERIES["op7_secret_scan"](spark, SF).collect()
    assert found and all(0 <= r["score"] <= 1 for r in found)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert OTHERS["column_match"](spark, SF).count() > 0
