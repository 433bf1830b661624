"""The pipeline on planted cases, stage by stage against plain code."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from triagelake.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer files")
BAD = ("vile", "awful", "nasty")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    shared = "This very line is in many of the documents"
    rows, kind = [], {}

    def add(t, k):
        kind[len(rows)] = k
        rows.append((len(rows), t, "en", "s", len(t) if t is not None else None))

    for i in range(120):
        add(text(60) + (f"\n{shared}" if i % 20 == 0 else ""), "clean")
    for _ in range(40):
        w = text(50).split()
        for _ in range(6):
            w.insert(rng.randrange(50), rng.choice(BAD))
        add(" ".join(w), "toxic")
    for i in range(5):
        add(text(40) + " " + items[i][1] + " " + text(40), "leak")
    for i in range(6):
        base = text(80).split()
        add(" ".join(base), f"group{i}")
        base[7] = "other"
        add(" ".join(base), f"group{i}")
    add(None, "null"), add("", "empty")
    d = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in kind if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r[1] for r in rows}, kind, shared


def test_pipeline_removes_what_is_planted_and_keeps_the_rest(spark, planted):
    path, source, kind, shared = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after, _ = corpus_pipeline.write_stage(stage(spark, before, path), f"test-{k}")
        ids, had = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (after, before))
        gone = {kind[i] for i in had - ids}
        if k < 4:
            assert after.schema == docs.schema
        if k == 0:
            assert gone == {"toxic"} and not any(kind[i] == "toxic" for i in ids)
        if k == 1:
            assert ids == had
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
            holders = [i for i, t in source.items() if t and shared in t]
            for i in ids:
                want = (source[i] or "").replace(f"\n{shared}", "") if i in holders and i != max(holders) else source[i] or ""
                assert texts[i][0] == want and (source[i] is None or texts[i][1] == len(want))
        if k == 2:
            assert sorted(gone - {"null", "empty"}) == [f"group{i}" for i in range(6)] and len(had - ids) == 7
        if k == 3:
            assert gone == {"leak"} and len(had - ids) == 5
        if k == 4:
            assert ids == had
            codec = pieces.Codec(open(pieces.MODEL_PATH, "rb").read())
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in after.collect():
                assert r["round_trip"] and r["parity"] and codec.decode([np.frombuffer(r["ids"], "<u2").tolist()])[0] == texts[r["doc_id"]]
        before = after


def test_run_equals_the_stages(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.count() == len([k for k in planted[2].values() if k == "clean"]) + 6 + 1
