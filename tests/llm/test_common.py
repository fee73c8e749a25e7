from __future__ import annotations

from foldspark.llm import common


def test_compact_of_no_rows(spark):
    out = common.compact(spark.range(0))
    assert out.count() == 0 and out.columns == ["id"]


def test_compact_collects_what_its_plan_held(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(common, "settle", settled.append)
    common.compact(spark.range(3))
    assert settled == [spark]
