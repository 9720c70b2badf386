"""How often near-duplicate detection passes over its sets."""

from sparkgrid.llm import near_dedup
from tests.llm import data


def test_open_documents_are_read_and_paired_once(spark, monkeypatch):
    plans, stage = {}, near_dedup.stage

    def watched(df, label="table"):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, label)
    monkeypatch.setattr(near_dedup, "stage", watched)
    rows = data.rows()
    found = near_dedup.near_duplicates(data.frame(spark, rows))
    assert found.count() == len(rows)
    assert plans["shared"].count("Generate explode(set") == 1
    # The links between open documents are written before they are counted and used.
    assert "more" in plans
