"""Inputs that once gave wrong answers: several files, ties, empty vectors, nested secrets, repeats."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.scale import scratch_dir
from triagelake.operators import calibration, parse, retrieval, scorers, splits, templates, windows
from triagelake.sources.text_logs import read_log_lines
from triagelake.streaming import triage


def test_windows_over_files_with_blank_lines(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("one\ntwo\n\n  \nfour\nfive\n")
    lines = read_log_lines(spark, str(tmp_path))
    assert sorted((r["record_index"], r["line_number"]) for r in lines.collect()) == sorted([(1, 1), (2, 2), (3, 5), (4, 6)] * 2)
    assert read_log_lines(spark, str(tmp_path), keep_blank=True).filter("record_index IS NULL").count() == 4
    parsed = parse.parse_lines(lines, "hdfs").withColumn("template_id", F.lit(1))
    w = windows.fixed_windows(parsed, 2, min_size=2, index="record_index").collect()
    assert len(w) == 4 and len({r["window_id"] for r in w}) == 4 and {r["record_count"] for r in w} == {2}


def test_equal_times_are_cut_by_rank(spark):
    w = spark.createDataFrame([("d", f"w{i}", 5.0, i) for i in range(10)], "dataset string, window_id string, start_time double, first_line long")
    got = {r["window_id"]: r["split"] for r in splits.chronological_split(w).collect()}
    assert [got[f"w{i}"] for i in range(10)] == ["train"] * 6 + ["calibration"] * 2 + ["test"] * 2


def test_empty_vectors_are_like_nothing(spark):
    corpus = spark.createDataFrame([("d", "c0", "w0", ""), ("d", "c1", "w1", "alpha beta")], "dataset string, chunk_id string, source_window_id string, text string")
    idf = retrieval.fit_idf(corpus)
    q = spark.createDataFrame([("d", "q", "")], "dataset string, query_id string, text string")
    got = retrieval.top_k(q, corpus, idf, k=2, exclude_self=False).collect()
    assert got and all(r["similarity"] == 0.0 for r in got)


def test_secrets_inside_maps_of_anything(spark):
    item = T.StructType([T.StructField("password", T.StringType()), T.StructField("note", T.StringType())])
    schema = T.StructType([T.StructField("a", T.MapType(T.StringType(), item)), T.StructField("b", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    df = spark.createDataFrame([({"x": ("hunter2", "token = abcdefgh1")}, {"token": ["s3cret"], "say": ["secret: abcdefgh1"]})], schema)
    row = parse.redact_nested(df).first()
    assert row["a"]["x"]["password"] == "[REDACTED]" and row["a"]["x"]["note"].endswith("[REDACTED]")
    assert row["b"]["token"] is None and row["b"]["say"] == ["secret: [REDACTED]"]


def test_another_bucket_never_changes_templates(spark, monkeypatch):
    own = [f"start {'xyz'[i % 3]}{chr(97 + i)} end{chr(97 + i // 3)}q" for i in range(24)]
    alone = {r["template"] for r in templates.mine_templates(spark.createDataFrame([(t,) for t in own], "content string")).collect()}
    monkeypatch.setattr(templates, "MAX_SHAPES_PER_BUCKET", 30)
    other = [f"load {chr(97 + i % 26)}{chr(97 + i // 26)} {chr(97 + i % 7)} k" for i in range(200)]
    both = {r["template"] for r in templates.mine_templates(spark.createDataFrame([(t,) for t in own + other], "content string")).collect()}
    assert alone == {t for t in both if t.startswith("start")} and any(t.startswith("load") for t in both)


def test_unmatched_lines_keep_their_row(spark):
    lines = spark.createDataFrame([(1, "open file"), (2, "never seen"), (3, None), (4, "open file"), (5, "")], "n long, content string")
    mined = templates.mine_templates(lines.filter("n = 1"))
    assert {r["n"]: r["template_id"] for r in templates.match_templates(lines, mined).collect()} == {1: 1, 2: -1, 3: -1, 4: 1, 5: -1}


def test_windows_without_templates_stay_and_long_ones_count_whole(spark):
    vocab = spark.createDataFrame([(i, i + 1) for i in range(1, 301)], "template_id int, idx int")
    w = spark.createDataFrame([("d", "a", [1, 2, None, 999]), ("d", "empty", []), ("d", "null", None), ("d", "long", [1] * 250)], "dataset string, window_id string, template_ids array<int>")
    for n in (3, 300):
        got = {r["window_id"]: r["tokens"] for r in scorers.encode_sequences(w, vocab.filter(F.col("template_id") <= n)).collect()}
        assert got["a"] == [2, 3, 1, 1] and got["empty"] == got["null"] == [] and len(got["long"]) == 250
    assert len({r["window_id"]: r["tokens"] for r in scorers.encode_sequences(w, vocab, 100).collect()}["long"]) == 100


def test_every_score_is_a_candidate(spark):
    rows = [(float(i), int(i >= 733)) for i in range(1000)]
    best = calibration.oracle_threshold(spark.createDataFrame(rows, "score double, y int")).first()
    assert best["threshold"] == 732.0 and best["f1"] == 1.0


def test_ties_of_time_do_not_swell_a_prefix(spark):
    rows = [(f"w{i}", 1.0, i, float(i), 0) for i in range(20)]
    calib = spark.createDataFrame(rows, "window_id string, start_time double, first_line long, score double, y int")
    got = {r["fraction"]: r for r in calibration.calibration_size_sensitivity(calib, (0.5, 1.0), alpha=0.5).collect()}
    assert got[0.5]["sample_size"] == 10 and got[0.5]["threshold"] < 10 <= got[1.0]["threshold"]


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    log = str(tmp_path / "log")
    write = triage.reviews_per_batch(log)
    batch = spark.createDataFrame([("i", "r", "ESCALATE", "CONFIRM", None, 1)], "incident_id string, reviewer_id string, machine_decision string, human_decision string, reason string, ts long")
    write(batch, 0), write(batch, 0), write(batch, 1)
    assert spark.read.parquet(log).count() == 2


def test_stage_folder_without_the_checkpoint_setting(spark):
    folder = scratch_dir(spark)
    assert folder == scratch_dir(spark)


def test_conflict_rows_don_t_filter_below_the_assessment(spark, tmp_path):
    from triagelake.plans import branches

    spark.range(1, 200).selectExpr("id AS o_orderkey", "id * 7 % 100 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = branches.conflict_grid(spark, str(tmp_path))
    filters = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("sha2" in line for line in filters)
    wanted = [(r["window_id"], c["conflict_id"], c["type"], c["severity"]) for r in branches.rs.assess(branches.incident_grid(spark, str(tmp_path))).select("window_id", "conflicts").collect() for c in r["conflicts"]]
    assert wanted and sorted(map(tuple, rows.collect())) == sorted(wanted)
