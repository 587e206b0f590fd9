"""The catalogue itself."""

import pytest

import __spark_entry__ as entry
from attesta.session import _written, forget, intermediates, materialise

ROOT = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_written_tables_can_be_forgotten(spark, tmp_path):
    kept = materialise(spark.range(3), "numbers", str(tmp_path))
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    own = _written.pop(spark.sparkContext.applicationId)  # other tests may still read theirs
    _written[spark.sparkContext.applicationId] = own[-1:]
    assert forget(spark) == 1 and not list(tmp_path.iterdir())


def test_intermediates_go_at_the_end_of_their_block(spark, tmp_path):
    before = list(_written.get(spark.sparkContext.applicationId, []))
    with pytest.raises(ValueError), intermediates(spark):
        materialise(spark.range(3), "outer", str(tmp_path))
        with intermediates(spark):
            assert materialise(spark.range(3), "inner", str(tmp_path)).count() == 3 and len(list(tmp_path.iterdir())) == 2
        assert [p.name.startswith("outer") for p in tmp_path.iterdir()] == [True]
        raise ValueError
    assert not list(tmp_path.iterdir()) and _written[spark.sparkContext.applicationId] == before


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_plan_prunes_columns_and_has_no_nested_loop(spark):
    plan = entry.queries()["provenance_typed"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "html" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["topk_per_source"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
