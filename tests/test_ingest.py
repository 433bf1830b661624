import pytest
from pyspark.sql import functions as F

from triagelake.operators import parse, splits, templates, windows
from triagelake.functions.scale import order_positions, running_totals
from triagelake.sources import text_logs, stages

HDFS = "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608999687919862906 src: /10.250.19.102:54106 dest: /10.250.19.102:50010"
BGL = "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.675872 R02-M1-N0-C:J12-U11 RAS KERNEL INFO instruction cache parity error corrected"


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "line_number long, raw_text string")


def records(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, line_number long, timestamp double, session_id string, template_id int, is_anomaly boolean")


def test_session_header(spark):
    row, bad = parse.parse_lines(lines(spark, HDFS, "  ", "THIS IS NOT A VALID HDFS LOG LINE"), "hdfs").orderBy("line_number").collect()
    assert row["session_id"] == "blk_-1608999687919862906" and row["log_level"] == "INFO" and row["component"] == "dfs.DataNode$DataXceiver"
    assert row["timestamp"] == 1226262918.0
    assert bad["line_number"] == 3 and bad["timestamp"] is None and bad["content"] is None


def test_alert_header(spark):
    a, b, c = parse.parse_lines(lines(spark, BGL, BGL.replace("- ", "FATAL ", 1), "too short"), "bgl").orderBy("line_number").collect()
    assert (a["is_anomaly"], a["timestamp"]) == (False, 1117838570.0)
    assert b["is_anomaly"] is True and c["is_anomaly"] is None


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        parse.parse_lines(lines(spark, "x"), "other")


def test_mining_is_order_free_and_matches(spark):
    texts = [f"Receiving block blk_{i} src: /10.0.0.{i}:80 dest: /a/b" for i in range(20)] + ["Served block blk_7 to /x", "Verification succeeded for blk_9"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    one = sorted(map(tuple, templates.mine_templates(df).collect()))
    two = sorted(map(tuple, templates.mine_templates(df.repartition(4, F.rand(1))).collect()))
    assert one == two and sum(t[2] for t in one) == len(texts)
    table = spark.createDataFrame(one, "template_id int, template string, size long")
    probe = spark.createDataFrame([(texts[0],), ("never seen before anywhere",)], "content string")
    hit, miss = templates.match_templates(probe, table).collect()
    assert "<*>" in hit["template"] and miss["template_id"] == -1 and miss["template"] == "UNKNOWN"


def test_session_windows(spark):
    r = records(spark, [(1, 100.0, "blk_001", 1, None), (2, 105.0, "blk_002", 1, None), (3, 110.0, "blk_001", 2, None), (4, 1.0, None, 2, None)])
    labels = spark.createDataFrame([("blk_002", True)], "session_id string, is_anomaly boolean")
    a, b = windows.session_windows(r, labels).orderBy("session_id").collect()
    assert (a["start_time"], a["end_time"], a["record_count"], a["is_anomaly"], a["unmapped_label"]) == (100.0, 110.0, 2, False, True)
    assert b["is_anomaly"] is True and b["unmapped_label"] is False


def test_fixed_windows(spark):
    r = records(spark, [(i, 10.0 * i, None, i, i == 3) for i in range(1, 6)])
    w = windows.fixed_windows(r, 2).orderBy("window_id").collect()
    assert [x["record_count"] for x in w] == [2, 2, 1] and [x["is_anomaly"] for x in w] == [False, True, False]
    assert [x["template_ids"] for x in w] == [[1, 2], [3, 4], [5]]
    assert windows.fixed_windows(r, 2, min_size=2).count() == 2


def test_positions_in_a_hot_session(spark):
    rows = [(i, float(i % 3), "hot" if i % 3 else "cold", 1, None) for i in range(1, 301)]
    got = windows.with_session_window(records(spark, rows), "s").collect()
    for sid in ("hot", "cold"):
        mine = sorted((r["timestamp"], r["line_number"], r["pos"]) for r in got if r["session_id"] == sid)
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_bucketed_running_totals_equal_the_single_window(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("s"), F.lit(1).alias("c"))
    for descending in (False, True):
        small = {r["s"]: r["t"] for r in running_totals(df, "s", {"t": "c"}, descending=descending).collect()}
        big = {r["s"]: r["t"] for r in running_totals(df, "s", {"t": "c"}, descending=descending, buckets=8).collect()}
        assert small == big


def test_positions_with_one_order_value(spark):
    df = spark.range(50).select(F.lit(1.0).alias("t"), F.col("id").alias("line"))
    got = order_positions(df, "t", "line").collect()
    assert all(r["pos"] == r["line"] for r in got)


def window_table(spark, times):
    return spark.createDataFrame([(f"w{i:03d}", t, i, "d") for i, t in enumerate(times)], "window_id string, start_time double, first_line long, dataset string")


@pytest.mark.parametrize(
    "times, sizes",
    [
        (range(10), (6, 2, 2)),
        ([0, 1, 2, 3, 4, 5, 5, 5, 8, 9], (5, 3, 2)),  # the cut moves to the start of the run
        ([0] * 8 + [1, 2], (8, 0, 2)),  # the first run cannot be cut, so the cut moves behind it
    ],
)
def test_split_snaps_to_time_changes(spark, times, sizes):
    w = splits.chronological_split(window_table(spark, [float(t) for t in times]))
    got = {r["split"]: r["count"] for r in w.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in splits.SPLITS) == sizes


def test_split_errors_and_guards(spark):
    w = window_table(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        splits.chronological_split(w, (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.chronological_split(w.limit(0))
    with pytest.raises(splits.LeakageError):
        splits.read_split(w.withColumn("split", F.lit("train")), "test")
    with pytest.raises(splits.LeakageError):
        splits.require_label_free(w.withColumn("meta", F.struct(F.lit(1).alias("is_anomaly"))))


def test_redaction(spark):
    df = spark.createDataFrame([("password=hunter2 ok", {"token": "x", "note": "bearer abcdefghijklmnop"})], "text string, m map<string,string>")
    row = parse.redact_nested(df).first()
    assert "hunter2" not in row["text"] and row["m"]["token"] == "[REDACTED]" and row["m"]["note"] == "bearer [REDACTED]"


def test_text_scan_line_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = {r["line_number"]: r["raw_text"] for r in text_logs.read_log_lines(spark, str(tmp_path / "a.log"), max_records=1500).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"line {i}" for i in range(1, 1501) if i % 5}


def test_labels_last_wins(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\nshort\nblk_1,anomaly\n")
    got = {r["session_id"]: r["is_anomaly"] for r in text_logs.read_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"blk_1": True, "blk_2": True}


def test_window_store_and_integrity(spark, tmp_path):
    r = records(spark, [(i, float(i), None, 1, False) for i in range(1, 11)])
    w = splits.chronological_split(windows.fixed_windows(r, 1))
    for fmt in ("parquet", "json"):
        stages.write_windows(w, str(tmp_path / fmt), fmt)
        assert stages.read_windows(spark, str(tmp_path / fmt), "train", fmt=fmt).count() == 6
    with pytest.raises(splits.LeakageError):
        stages.read_windows(spark, str(tmp_path / "parquet"), "test")
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = text_logs.file_integrity(spark, str(tmp_path / "f.bin"))
    row = files.first()
    assert row["size_bytes"] == 3 and row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    want = spark.createDataFrame([(row["path"], row["sha256"].upper())], "path string, sha256 string")
    assert text_logs.verify_files(files, want).first()["matches"] is True
