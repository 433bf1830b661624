"""A bucket cut into parts gives the templates that one task gives."""

import random

from pyspark.sql import functions as F

from triagelake.operators import templates


def random_lines(rng, n):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    kinds = [[rng.choice(words) for _ in range(rng.choice([4, 7, 10]))] for _ in range(60)]
    out = []
    for _ in range(n):
        line = list(rng.choice(kinds))
        for _ in range(rng.randrange(5)):
            line[rng.randrange(1, len(line))] = rng.choice(words)
        out.append((" ".join(["go", *line]),))
    return out + [("start job",), ("start work",), ("start it",), ("one",), ("go",)]


def mined(spark, lines):
    return sorted((r["template"], r["size"]) for r in templates.mine_templates(lines).collect())


def test_parts_give_the_templates_of_one_task(spark, monkeypatch):
    lines = spark.createDataFrame(random_lines(random.Random(8), 1_500), "content string").repartition(5)
    whole = mined(spark, lines)
    shapes = lines.groupBy(templates.shape_tokens(F.col("content")).alias("tokens")).agg(F.count(F.lit(1)).alias("size")).withColumn("len", F.size("tokens")).withColumn("first", F.get("tokens", F.lit(0)))
    monkeypatch.setattr(templates, "MAX_SHAPES_PER_BUCKET", 1)
    assert mined(spark, lines) == whole
    parts = templates.independent_parts(shapes)
    assert parts.count() == shapes.count()
    assert parts.select("len", "first", "part").distinct().count() > 3 * shapes.select("len", "first").distinct().count()


def test_shapes_that_agree_enough_share_a_part(spark, monkeypatch):
    monkeypatch.setattr(templates, "MAX_SHAPES_PER_BUCKET", 1)
    lines = spark.createDataFrame(random_lines(random.Random(9), 400), "content string")
    shapes = lines.groupBy(templates.shape_tokens(F.col("content")).alias("tokens")).agg(F.count(F.lit(1)).alias("size")).withColumn("len", F.size("tokens")).withColumn("first", F.get("tokens", F.lit(0)))
    rows = templates.independent_parts(shapes).collect()
    for a in rows:
        for b in rows:
            if a["len"] == b["len"] and a["first"] == b["first"] and sum(x == y for x, y in zip(a["tokens"], b["tokens"])) >= a["len"] / 2:
                assert a["part"] == b["part"]


def test_labels_follow_long_chains(spark):
    rows = [(i, k) for i in range(200) for k in (i, i + 1)] + [(1000, 5000), (1001, 5000), (2000, 9999)]
    out = {r["id"]: r["label"] for r in templates.linked(spark.createDataFrame(rows, "id long, key long")).collect()}
    assert {out[i] for i in range(200)} == {0} and out[1001] == 1000 and out[2000] == 2000
