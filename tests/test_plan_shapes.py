"""Scale lint over every registered query: the physical plans must not
contain the operators that break at scale."""

import pytest

from tidemark.queries import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate",
             "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")
TOP_K = ("TakeOrderedAndProject", "GlobalLimit", "CollectLimit")


def _nodes(node, below_top_k=False):
    """(node name, partition keys empty?, is a top-k below it) for every node."""
    name = node.nodeName()
    seq = node.children()
    children = [seq.apply(i) for i in range(seq.size())]
    has_top_k = any(_contains(c, TOP_K) for c in children)
    empty_partition = name == "Window" and node.partitionSpec().isEmpty()
    yield name, empty_partition, has_top_k
    for c in children:
        yield from _nodes(c)


def _contains(node, names):
    if node.nodeName() in names:
        return True
    seq = node.children()
    return any(_contains(seq.apply(i), names) for i in range(seq.size()))


def _gathered_quantile(node):
    """A percentile aggregate without grouping keys merges all tasks' values in one."""
    text = node.toString()
    return any("percentile" in line and "keys=[]" in line for line in text.split("\n"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_plan_shape(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan()
    nodes = list(_nodes(plan))
    names = {n for n, _, _ in nodes}
    for op in FORBIDDEN:
        assert op not in names, f"{name}: {op} in plan"
    assert not _gathered_quantile(plan), f"{name}: a quantile's values meet in one task"
    for node_name, empty_partition, has_top_k in nodes:
        if empty_partition:
            assert has_top_k, f"{name}: window without partition keys over unbounded rows"


def test_lint_sees_top_k_window(spark):
    df = QUERIES["top_entities"](spark, "/root/testdata/sf0.001")
    nodes = list(_nodes(df._jdf.queryExecution().sparkPlan()))
    assert any(empty for _, empty, _ in nodes)
