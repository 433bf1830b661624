"""Template mining follows one rule at every number of shapes."""

import pytest

from triagelake.operators.templates import mine_templates


def word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:05d}")


@pytest.mark.parametrize("n", [1_500, 3_000])
def test_many_shapes_of_one_bucket_give_one_template(spark, n):
    lines = spark.createDataFrame([(f"start job {word(i)} {word(99_999 - i)}",) for i in range(n)] + [("stop now",), ("stop now",)], "content string")
    got = {(r["template"], r["size"]) for r in mine_templates(lines.repartition(7)).select("template", "size").collect()}
    assert got == {("start job <*> <*>", n), ("stop now", 2)}
