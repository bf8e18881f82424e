"""The queries on TF-IDF candidates score pairs in cells, once per query, and list no pairs that share a token."""

import re

import pytest

import __spark_entry__

NAMES = """assign_soft best_other_margin best_s1_addback best_variant char_trigram_topk claims component_states contention_means country_diagnosis decide_by_country decision_grid
    ensemble_logit entity_f05 entity_shape expected_f expected_f_exact expected_f_joint gather_records hard_negatives jaro_winkler macro_f05""".split()


@pytest.mark.parametrize("name", NAMES)
def test_cells_run_once(spark, name):
    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    out.collect()
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("MapInArrow", ran)) == 1, name
