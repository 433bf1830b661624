"""Steps that were too slow on larger tables: the same results by less work."""

import pandas as pd
from pyspark.sql import functions as F

from triagelake.functions import scale
from triagelake.operators import parse, templates
from triagelake.streaming import triage


def test_lines_are_masked_once_for_mining_and_matching(spark):
    texts = ["Handled view from 10.0.0.1:80 code 7", "Handled view from 10.0.0.2:80 code 8", "x7y \u00e91 \u2028", "", "only words"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "n long, content string")
    shaped = scale.materialize(templates.with_shape(df), "shaped")
    assert {r["n"]: r["shape"] for r in shaped.collect()} == {0: "Handled view from <*> code <*>", 1: "Handled view from <*> code <*>", 2: "<*> <*>", 3: "", 4: "only words", 9: None}
    mined = templates.mine_templates(shaped, shape="shape")
    assert sorted(map(tuple, mined.collect())) == sorted(map(tuple, templates.mine_templates(df).collect()))
    # no pattern runs over the contents again
    plan = templates.match_templates(shaped, mined, shape="shape")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    both = [sorted(map(str, t.select("n", "template_id", "template").collect())) for t in (templates.match_templates(shaped, mined, shape="shape"), templates.match_templates(df, mined))]
    assert both[0] == both[1]


def test_header_groups_come_from_one_pass(spark):
    head = "081109 203518 143 INFO "
    rows = [(1, head + "a.b: c \x01d"), (2, head + "a.b: c d"), (3, head + " : x"), (4, "no header"), (5, "\x01".join("abcdef"))]
    parsed = parse.parse_lines(spark.createDataFrame(rows, "line_number long, raw_text string"), "hdfs")
    got = {r["line_number"]: (r["log_level"], r["component"], r["content"]) for r in parsed.collect()}
    assert got == {1: ("INFO", "a.b", "c \x01d"), 2: ("INFO", "a.b", "c d"), 3: ("INFO", "", "x"), 4: (None, None, None), 5: (None, None, None)}
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(_line") == 1


def test_positions_of_small_groups_need_no_cuts(spark, monkeypatch):
    rows = [(g, float((i * 7) % 5), i) for g, n in (("a", 3), ("b", 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, t double, line long")
    want = {(g, line): p for g in "abc" for p, (_, line) in enumerate(sorted((t, line) for h, t, line in rows if h == g))}
    small = scale.order_positions(df, "t", "line", by=["g"])
    assert "percentile_approx" not in small._jdf.queryExecution().toString()
    monkeypatch.setattr(scale, "SINGLE_WINDOW_ROWS", 10)  # b is cut, the others aren't
    for got in (small, scale.order_positions(df, "t", "line", by=["g"])):
        assert got.columns == ["g", "t", "line", "pos"]
        assert {(r["g"], r["line"]): r["pos"] for r in got.collect()} == want


class _State:
    """A group's state as the stream holds it."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.now, self.timer = None, False, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists, self.timer = None, False, None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.now
        self.timer = ms


def test_a_block_of_windows_is_one_call():
    step, state = triage._collect_window(2, 1, 1_000), _State()

    def call(rows, late=False):
        state.hasTimedOut = late
        b = [pd.DataFrame([r], columns=["window_id", "line_number", "timestamp", "is_anomaly", "surprise"]) for r in rows]
        out = list(step(("d", 0), iter(b), state))
        return [tuple(r) for t in out for r in t.drop(columns="dataset").itertuples(index=False)]

    first = call([("w0", 2, 20.0, None, 1.0), ("w0", 1, 10.0, True, 2.0), ("w1", 3, 30.0, False, 4.0), ("w2", 5, 50.0, True, 5.0)])
    assert first == [("w0", 10.0, 20.0, 2, 1, 1.5, True)]
    assert state.timer == 31_000  # w1's, the first to be late
    state.now = 31_001
    assert call([], late=True) == [("w1", 30.0, 30.0, 1, 0, 4.0, False)]
    assert call([("w1", 4, 31.5, False, 1.0), ("w2", 6, 55.0, False, 2.0)]) == [("w2", 50.0, 55.0, 2, 1, 3.5, True)]
    state.now = 32_002
    assert call([], late=True) == [] and not state.exists
