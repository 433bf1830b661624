"""Sessions cut into segments against plain code over whole sessions."""

import hashlib
import math
import random

import pytest

from triagelake.operators import scorers, sessions


def make(rng):
    return {f"s{i}": [rng.choice([1, 2, 3, 7, -1, None]) for _ in range(rng.choice([1, 2, 5, 30]))] for i in range(25)}


def frame(spark, data):
    rows = [("d", w, pos, t, f"  line {t} of {w} ") for w, ts in data.items() for pos, t in enumerate(ts)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "dataset string, window_id string, pos long, template_id int, raw_message string").repartition(3)


def tree(items, separator, n):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes = [digest(separator.join(items[i : i + n])) for i in range(0, len(items), n)]
    while len(nodes) > 1:
        nodes = [digest(",".join(nodes[i : i + n])) for i in range(0, len(nodes), n)]
    return nodes[0]


@pytest.mark.parametrize("segment", [2, 3, 1_000])
def test_content_hashes_are_trees_of_segments(spark, segment):
    data = make(random.Random(1))
    got = {r["window_id"]: (r["source_hash"], r["template_hash"]) for r in sessions.content_hashes(frame(spark, data), segment).collect()}
    name = lambda t: f"template_{t}" if t is not None and t >= 0 else "template_unknown"
    assert got == {w: (tree([f"line {t} of {w}" for t in ts], "\n", segment), tree([name(t) for t in ts], " ", segment)) for w, ts in data.items()}


@pytest.mark.parametrize("segment", [1, 4, 1_000])
def test_steps_and_scores_equal_whole_sequences(spark, segment):
    data = make(random.Random(2))
    vocab = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "template_id int, idx int")
    token = lambda t: {1: 2, 2: 3, 3: 4}.get(t, 1)
    steps = sessions.session_steps(frame(spark, data), vocab, segment)
    want = {}
    for w, ts in data.items():
        k = [token(t) for t in ts]
        for a, b in zip([None, *k], k):
            want[w, a, b] = want.get((w, a, b), 0) + 1
    assert {(r["window_id"], r["prev"], r["next"]): r["n"] for r in steps.collect()} == want
    whole = spark.createDataFrame([("d", w, [token(t) for t in ts]) for w, ts in data.items()], "dataset string, window_id string, tokens array<int>")
    old = {r["window_id"]: r["score"] for r in scorers.next_template_scores(whole, scorers.fit_next_template(whole, 4)).collect()}
    new = {r["window_id"]: r["score"] for r in sessions.step_scores(steps, sessions.fit_steps(steps, 4)).collect()}
    assert new.keys() == old.keys() and all(math.isclose(new[w], old[w], abs_tol=2e-9) for w in old)


def test_a_session_with_a_third_of_the_rows_is_many_groups(spark):
    data = {"hot": [random.Random(3).choice([1, 2]) for _ in range(3_000)]} | {f"s{i}": [1, 2] for i in range(3_000)}
    steps = sessions.session_steps(frame(spark, data), spark.createDataFrame([(1, 2), (2, 3)], "template_id int, idx int"), 100)
    assert sum(r["n"] for r in steps.filter("window_id = 'hot'").collect()) == 3_000
    hashed = sessions.content_hashes(frame(spark, data), 100)
    assert hashed.count() == 3_001


def test_empty_records(spark):
    empty = frame(spark, {"x": [1]}).limit(0)
    assert sessions.content_hashes(empty).collect() == []
    assert sessions.session_steps(empty, spark.createDataFrame([(1, 2)], "template_id int, idx int")).collect() == []
