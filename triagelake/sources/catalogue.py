"""Named stage tables of one run: schema-checked, read back, and removed when the run is over."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.scale import scratch_dir

#: columns that a stage of this name must have, whatever others it has
REQUIRED = {
    "windows": "dataset string, window_id string, split string, record_count bigint, is_anomaly boolean",
    "corpus": "dataset string, chunk_id string, source_window_id string, text string, template_ids array<int>",
    "vectors": "dataset string, chunk_id string, vec array<struct<token:string,weight:double>>, direction string",
    "evidence": "dataset string, query_id string, rank int, similarity double, chunk_id string, source_window_id string",
    "citations": "dataset string, query_id string, citation_id string, chunk_id string, source_window_id string, source_content_hash string, template_content_hash string, status string",
    "bundles": "dataset string, query_id string, bundle_id string, evidence_count int, all_verified boolean",
    "assessments": "dataset string, window_id string, final_decision string, severity string, confidence double, rule_fired string",
}


class StageError(ValueError):
    """A stage is missing, has another schema than it must, or is written twice."""


def _columns(schema: str) -> dict[str, str]:
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(part.strip().split(" ", 1))
            part = ""
        else:
            part += c
    return dict(out)


class Catalogue:
    """The stages of one run under ``root/run_id``; a folder that all executors share.

    As a context manager it removes, at the end of the block, every stage that wasn't kept.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, run_id: str | None = None) -> None:
        self.spark, self.run_id = spark, run_id or uuid.uuid4().hex
        self.path = f"{(root or scratch_dir(spark)).rstrip('/')}/run-{self.run_id}"
        self._kept: set[str] = set()

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._hadoop(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(p)

    def names(self) -> list[str]:
        """The finished stages."""
        fs, p = self._hadoop(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self.exists(s.getPath().getName())) if fs.exists(p) else []

    def write(self, name: str, df: DataFrame, required: str | None = None) -> DataFrame:
        """Write a stage and read it back. Its columns are checked first; a name is written once."""
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        want = _columns(required or REQUIRED.get(name, "")) if required or name in REQUIRED else {}
        wrong = [f"{c} {t}" for c, t in want.items() if have.get(c) != t]
        if wrong:
            raise StageError(f"stage {name!r} lacks {wrong}, has {have}")
        if self.exists(name):
            raise StageError(f"stage {name!r} of run {self.run_id} is written already")
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")  # what a failed try left is replaced
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise StageError(f"run {self.run_id} has no stage {name!r}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def status(self, stage: str, rows: DataFrame, status: str = "COMPLETED") -> None:
        """Record that a stage dealt with these windows."""
        self.write(f"status-{stage}", rows.select("dataset", "window_id", F.lit(stage).alias("stage"), F.lit(status).alias("status")).distinct())

    def statuses(self, stages: Sequence[str]) -> DataFrame:
        """(dataset, window_id, stage, status) of those stages that recorded any."""
        out = self.spark.createDataFrame([], "dataset string, window_id string, stage string, status string")
        for s in stages:
            if self.exists(f"status-{s}"):
                out = out.unionByName(self.read(f"status-{s}"))
        return out

    def keep(self, *names: str) -> None:
        self._kept.update(names)

    def remove(self, *names: str) -> None:
        """Delete these stages, or the whole run."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            fs, p = self._hadoop(path)
            fs.delete(p, True)

    def __enter__(self) -> Catalogue:
        return self

    def __exit__(self, *_) -> None:
        gone = [n for n in self.names() if n not in self._kept]
        if self._kept:
            if gone:
                self.remove(*gone)
        else:
            self.remove()
