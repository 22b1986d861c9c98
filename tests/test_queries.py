"""Every registered query against its SQL, and plan checks."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from check_queries import compare, connect
from eventflow import plans

SF_DIR = "/root/testdata/sf0.001"
# queries that run user code, walk documents, or start a stream
PYTHON = ("b", "h", "r6", "r7", "d11", "s1_", "s8", "s9", "s10", "request_chain", "poll_chain")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    rows, wrong = compare(spark, con, name, plans.QUERIES[name], plans.SQL.get(name), SF_DIR)
    assert wrong is None and rows > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 40
    late = [(r.topic, r.shard_id, r.current, r.committed) for r in rows if r.lag]
    assert late == [("purchase", 5, 24, 23)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_queries_have_no_python(spark):
    for name, fn in plans.QUERIES.items():
        if name.startswith(PYTHON) or name.endswith("_stream"):
            continue
        plan = plan_of(fn(spark, SF_DIR))
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = plan_of(entry_module.queries()["m9_stuck_events"](spark, SF_DIR))
    assert "props" not in plan and "user_id" not in plan
    plan = plan_of(entry_module.queries()["shard_report"](spark, SF_DIR))
    assert plan.count("Exchange") == 1


def test_every_operator_is_registered():
    """One query and one SQL text at least for each operator id."""
    counts = {"e": 13, "s": 10, "h": 9, "f": 7, "b": 3, "d": 12, "m": 11, "l": 11, "r": 15}
    wanted = {f"{group}{i}" for group, n in counts.items() for i in range(1, n + 1)}
    assert wanted <= {name.split("_")[0] for name in plans.QUERIES}
    assert set(plans.SQL) == set(plans.QUERIES) and set(plans.QUERIES) <= set(entry_module.queries())


def test_shared_folder():
    from types import SimpleNamespace

    from eventflow.session import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
                               sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", "/shared/place/")) == "/shared/place"
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("local[2]", None)) != shared_dir(session("local[2]", None))
