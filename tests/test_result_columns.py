"""Scores of which only some columns are wanted."""

from conftest import SF

from tidemark.operators import indices as ix
from tidemark.plans import mapping, scoring, searching


def test_unwanted_columns_are_not_computed(spark):
    """The plan of provenance alone holds no score; the columns are those of the whole results."""
    frame = scoring.features(spark, SF)
    names = ("version", "prov_A", "prov_Q")
    some = ix.evaluate(frame, "V6", "proxy", sensitivities=False, columns=names)
    whole = ix.evaluate(frame, "V6", "proxy", sensitivities=False)
    assert some.columns == list(names)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toJSON())
    assert size(some) < size(whole) / 2
    assert some.exceptAll(whole.select(*names)).isEmpty() and some.count() == whole.count()


def test_strongest_strict_scores_no_other_mode(spark, monkeypatch):
    """Ranks and utility are within a mode, so the strict report stages strict scores only, and only columns it reads."""
    seen = []

    def results(spark, sf_dir, mode="hybrid", versions=("V4", "V6"), sens=False, columns=None):
        seen.append((mode, columns))
        return mapping.results(spark, sf_dir, mode, versions, sens, columns)

    monkeypatch.setattr(searching, "results", results)
    assert len(searching.strongest(spark, SF).collect()) == 1
    assert seen == [("strict", mapping.METRICS)]
