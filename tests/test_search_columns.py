"""The search stages what its objective reads."""

from conftest import SF

from tidemark.operators import search as se
from tidemark.plans import scoring, searching
from tidemark.plans.staging import stage


def test_search_stages_only_judged_columns(spark):
    seen = []

    def noted(df, name):
        seen.append(df.columns)
        return stage(df, name)

    found = se.evaluate_candidates(scoring.features(spark, SF), searching.candidates(spark, "V7", 2), "V7", 2, staging=noted)
    assert found.count() == 2
    assert seen == [["trial_index", "fold", "label", "Gamma", "score"]]
