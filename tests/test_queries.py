"""Every registered query against its SQL twin, and what their plans may not hold."""

from __future__ import annotations

import pytest
from compare import check, twin

import __spark_entry__ as entry
from callgauge.plans import inputs
from callgauge.plans.queries import REGISTRY
from conftest import SMALL

QUERIES = {name: build for name, build in entry.queries().items() if name in REGISTRY}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def connection():
    return twin(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, connection, name):
    assert check(spark, connection, name, QUERIES[name], ORACLE[name], SMALL) == []


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plans_stay_built_in(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for unwanted in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


def test_entry_gives_the_summary(spark):
    assert entry.entry(spark).count() == 1


FACTS = {
    "/root/testdata/sf0.001": (1000, 201, 5005.019, 14360.75, 38434, 115302, 1),
    "/root/testdata/sf0.01": (10000, 2014, 4963.0657, 14735.35, 397218, 1191654, 14),
}


@pytest.mark.parametrize("sf_dir", list(FACTS))
def test_known_numbers(spark, sf_dir):
    row = QUERIES["metrics_summary"](spark, sf_dir).first()
    calls, errors, average, p95, tokens_in, tokens_out, last_hour = FACTS[sf_dir]
    assert (row.total_calls, row.error_count) == (calls, errors)
    assert row.avg_latency_ms == pytest.approx(average) and row.p95_latency_ms == pytest.approx(p95)
    assert (row.total_input_tokens, row.total_output_tokens, row.calls_last_hour) == (tokens_in, tokens_out, last_hour)


def test_last_n_limits_before_the_shuffle(spark):
    text = plan(QUERIES["last_n_messages"](spark, SMALL))
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.count("WindowGroupLimit") == 2


def test_recent_is_a_top_k(spark):
    from callgauge.operators.metrics import recent_logs

    assert "TakeOrderedAndProject" in plan(recent_logs(inputs.previewed_logs(spark, SMALL)))
    for name in ("recent_logs", "log_display"):
        text = plan(QUERIES[name](spark, SMALL))
        # Deeper in a plan is later in its text: the top-k is taken before the messages are met.
        assert text[: text.index("== Physical")].count("Join") and "TakeOrderedAndProject" in text
        assert text.rindex("TakeOrderedAndProject") > text.index("Join", text.index("== Physical"))


def test_input_previews_move_nothing(spark):
    text = plan(QUERIES["input_previews"](spark, SMALL))
    assert "Exchange" not in text and "Window" not in text
