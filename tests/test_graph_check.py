"""The graph check joins by shuffle: its nodes never reach the driver."""

from triagelake.operators.monitoring import dangling_edges

NODES = [("a", "n1"), ("a", "n2"), ("a", "n2"), ("b", "n1"), (None, "n3"), ("c", None)]
EDGES = [("a", "n1", "n2"), ("a", "n1", "n9"), ("b", "n1", "n2"), (None, "n3", "n3"), ("c", None, "n1")]


def dangling(spark):
    nodes = spark.createDataFrame(NODES, "incident_id string, id string")
    return dangling_edges(nodes, spark.createDataFrame(EDGES, "incident_id string, source string, target string"))


def test_nodes_are_not_broadcast(spark):
    out = dangling(spark)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_endpoints_without_a_node(spark):
    got = sorted(((r["incident_id"], r["id"]) for r in dangling(spark).collect()), key=str)
    assert got == sorted([("a", "n9"), ("b", "n2"), (None, "n3"), (None, "n3"), ("c", None), ("c", "n1")], key=str)
