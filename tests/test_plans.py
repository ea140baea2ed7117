"""Plan-shape regression tests: the properties that matter at scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q(spark, sf):
    qs = E.queries()
    return lambda name: plan_of(qs[name](spark, sf))


def test_flagship_pushes_filter_and_prunes_columns(q):
    p = q("agg_monthly")
    assert "EqualTo(o_orderstatus,F)" in p
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"o_orderstatus", "o_totalprice", "o_orderdate"}
    assert "partial_sum" in p  # map-side partial aggregation


def test_topk_uses_bounded_heaps(q):
    p = q("agg_topk")
    assert "WindowGroupLimit" in p  # k rows a metric and task reach the shuffle
    assert not re.search(r"Exchange rangepartitioning", p)  # no global sort


def test_totals_are_scalar_subqueries_not_joins(q):
    for name in ("share_of_total", "summary_topn"):
        p = q(name)
        assert "Subquery" in p
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_group_stats_join_is_broadcast_when_small(q):
    p = q("udf_apply_in_pandas")
    assert "BroadcastHashJoin" in p and "MapInPandas" in p
    assert "FlatMapGroupsInPandas" not in p  # no whole group in one Python worker


def test_prepare_chain_drops_sort_under_dedupe(q):
    p = q("prepare_chain")
    assert "Sort " not in p.split("\n\n\n")[0]
    assert "In(l_returnflag" in p


def test_no_python_udf_in_filters_and_aggregates(q):
    for name in ("filter_and_or", "agg_grouped", "describe_numeric", "chart_corr", "run_checks"):
        p = q(name)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas", p), name
