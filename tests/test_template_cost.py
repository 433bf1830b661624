"""Mining masks a line once, sends templates back in bulk, and finds a place in the order without a look at every cut."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from triagelake.functions.scale import _cuts_below, _with_cuts, running_totals
from triagelake.operators import templates


def test_lines_are_masked_once(spark, monkeypatch):
    plans, write = [], templates.materialize
    monkeypatch.setattr(templates, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    lines = spark.createDataFrame([("start job 17",), ("start job x9",), ("",), ("  ",), (None,), ("77",)], "content string")
    got = {(r["template"], r["size"]) for r in templates.mine_templates(lines).collect()}
    assert got == {("start job <*>", 2), ("<*>", 1)}
    assert plans[0].count(r"blk_-?\d+") == 1


def test_many_small_buckets_come_back_in_few_batches():
    n = 4_000
    rows = [(2, f"k{i:05d}", 0, f"k{i:05d} a", 3) for i in range(n)] + [(3, "z", 0, "z a b", 2), (3, "z", 0, "z a c", 1), (3, "z", 1, "z q <*>", 1), (3, "z", 1, "z r <*>", 1)]
    parts = [pa.RecordBatch.from_pylist([dict(zip(("len", "first", "part", "text", "size"), r)) for r in rows[i : i + 999]]) for i in range(0, len(rows), 999)]
    out = list(templates._merge_sorted(0.5)(iter(parts)))
    assert len(out) <= 2
    got = [(t, s) for b in out for t, s in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(f"k{i:05d} a", 3) for i in range(n)] + [("z a <*>", 3), ("z q <*>", 1), ("z r <*>", 1)]


def test_place_in_the_order_is_worked_out_once(spark):
    words = [f"prefix {i % 50:02d} {i}" for i in range(400)] + ["é", "", "zz", None]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "s string, c long")
    out = running_totals(df, "s", {"t": "c"}, buckets=9)
    want, total = {}, 0
    for w in sorted(words, key=lambda w: (w is not None, (w or "").encode())):
        total += words.index(w) + 1
        want[w] = total
    assert {r["s"]: r["t"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan
    for m in re.finditer(r"lambdafunction\(", plan):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        assert "conv(" not in plan[m.end() : end]


def test_place_among_cuts_with_values_that_are_no_number(spark):
    values = [[float("nan"), float("inf"), None, 0.0, -0.0, float("-inf"), ((i * 7919) % 997) / 997][i % 7] for i in range(3_000)]
    df = _with_cuts(spark.createDataFrame([(v,) for v in values], "s double"), "s", [], 200)
    counted = F.size(F.filter("_cuts", lambda c: c < F.col("s")))
    rows = df.select(counted.alias("n"), _cuts_below(F.col("_cuts"), F.col("s"), 199).alias("found")).collect()
    assert [r["found"] for r in rows] == [r["n"] for r in rows] and max(r["n"] for r in rows) > 100
