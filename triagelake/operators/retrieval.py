"""Exact top-k retrieval of past windows for the escalated few.

Log windows repeat a lot, so both sides are collapsed to distinct directions (unit vectors) first.
A query whose own direction has enough members in the corpus is answered by an equi-join. Only the
rest is compared with distinct corpus directions, of a large corpus only with those in pivot cells near
enough; a task holds one block of each side and emits k rows per query, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scale import materialize, pin_small, running_totals
from triagelake.functions.text import lower_key, sha, words
from triagelake.operators import cells
from triagelake.operators.cells import BLOCK_ROWS
from triagelake.operators.splits import require_split


def template_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda t: F.when(t >= 0, F.concat(F.lit("template_"), t)).otherwise(F.lit("template_unknown"))), " ")


def chunk_id(dataset: Column, split: Column, window_id: Column, text: Column) -> Column:
    return sha(lower_key(dataset), lower_key(split), F.trim(window_id), text)


def build_corpus(windows: DataFrame, split: str = "train") -> DataFrame:
    """Chunks of the TRAIN windows. The label rides along for diagnosis only."""
    require_split(split, ("train",))
    w = windows.filter(F.col("split") == split).withColumn("text", template_text(F.col("template_ids")))
    return w.select(
        chunk_id(F.col("dataset"), F.col("split"), F.col("window_id"), F.col("text")).alias("chunk_id"),
        "dataset", "split", F.col("window_id").alias("source_window_id"), "session_id", F.col("start_time").alias("timestamp_start"),
        F.col("end_time").alias("timestamp_end"), "record_count", "template_ids", "text", F.col("is_anomaly").alias("anomaly_label"),
    )


def build_queries(windows: DataFrame) -> DataFrame:
    """Label-free queries with the same text form."""
    return windows.select(F.col("window_id").alias("query_id"), "dataset", "record_count", "template_ids", template_text(F.col("template_ids")).alias("text"))


def token_counts(df: DataFrame, key: str) -> DataFrame:
    rows = df.select("dataset", key, F.explode(words(F.lower("text"))).alias("token"))
    return rows.groupBy("dataset", key, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(corpus: DataFrame, key: str) -> DataFrame:
    """(token, df): in how many items a token is, for texts that are read from a table.

    A row's tokens are told apart in the row, so map tasks send one row per token. Only rows that share
    their key with another are told apart by shuffle, as one item.
    """
    again = pin_small(corpus.groupBy("dataset", key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(F.col("dataset").alias("_d"), F.col(key).alias("_k"), F.lit(True).alias("_again")))
    # one pass over a long text: what stripping would cut off is an empty token here
    rows = corpus.select("dataset", key, F.array_distinct(F.array_remove(F.split(F.lower("text"), r"\s+"), "")).alias("tokens"))
    if again.isEmpty():
        return materialize(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    rows = rows.join(again, F.col("dataset").eqNullSafe(F.col("_d")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_d", "_k")
    single = rows.filter(F.col("_again").isNull()).select(F.explode("tokens").alias("token"))
    shared = rows.filter("_again").select("dataset", key, F.explode("tokens").alias("token")).distinct().select("token")
    return materialize(single.unionByName(shared).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")


def fit_idf(corpus: DataFrame, key: str = "chunk_id", counts: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """Smoothed inverse document frequency per token: ln((1+n)/(1+df)) + 1. ``counts`` or ``frequencies`` stand for the texts."""
    n = corpus.count()
    if frequencies is None:
        counts = token_counts(corpus, key) if counts is None else counts
        frequencies = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = frequencies
    return pin_small(df.select("token", "df", (F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1).alias("idf")))


def vocabulary_hash(idf: DataFrame) -> DataFrame:
    """One row: SHA-256 over the ordered vocabulary with the index of every token, and the number of groups.

    Tokens are grouped by the first three hex digits of their own hash; the digests of at most 4,096
    groups are folded in order. So no row holds all tokens, and any engine can say the same.
    """
    ranked = running_totals(idf.select("token", F.lit(1).alias("one")), "token", {"rank": "one"})
    entry = F.concat_ws(":", "token", (F.col("rank") - 1).cast("string"))
    parts = ranked.groupBy(F.substring(F.sha2("token", 256), 1, 3).alias("g")).agg(F.array_sort(F.collect_list(F.struct("token", entry.alias("e")))).alias("t"))
    folded = parts.select("g", F.sha2(F.array_join("t.e", ","), 256).alias("h"))
    return folded.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("g", "h"))).getField("h"), ","), 256).alias("vocabulary_hash"), F.count(F.lit(1)).alias("groups"))


def tfidf_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Unit-length weights (key, token, weight); unknown tokens carry none."""
    raw = counts.join(idf.select("token", "idf"), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("dataset", key)))
    return raw.select("dataset", key, "token", (F.col("w") / norm).alias("weight"))


def sparse_vectors(df: DataFrame, idf: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """One row per item: ordered (token, weight) vector and its direction id; may be empty.

    ``counts`` (dataset, key, token, tf) stands for the texts where items have none.
    """
    w = tfidf_weights(token_counts(df, key) if counts is None else counts, idf, key)
    entry = F.struct("token", F.round("weight", 9).alias("weight"))
    vec = w.groupBy("dataset", key).agg(F.array_sort(F.collect_list(entry)).alias("vec"))
    empty = F.array().cast("array<struct<token:string,weight:double>>")
    out = df.select("dataset", key).join(vec, ["dataset", key], "left").withColumn("vec", F.coalesce("vec", empty))
    return out.withColumn("direction", F.sha2(F.to_json("vec"), 256))


def _block_kernel(keep: int, sparse: bool):
    """Top ``keep`` of one block pair. Sparse keys name directions, so equal keys mean cosine 1."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"dataset": [], "qkey": [], "ckey": [], "first_chunk": [], "sim": []}
        if len(q) and len(c):
            c = c.sort_values("first_chunk").reset_index(drop=True)
            ckeys, chunks, rank = c["ckey"].to_numpy(), c["first_chunk"].to_numpy(), np.arange(len(c))
            for lo in range(0, len(q), cells.PART):
                part = q.iloc[lo : lo + cells.PART]
                best, sims = cells.best_of_part(part, c, rank, keep, sparse, sparse)
                k = best.shape[1]
                out["dataset"].append(np.repeat(part["dataset"].to_numpy(), k))
                out["qkey"].append(np.repeat(part["qkey"].to_numpy(), k))
                out["ckey"].append(ckeys[best].ravel())
                out["first_chunk"].append(chunks[best].ravel())
                out["sim"].append(sims.ravel())
        return cells.frame(out)

    return run


def _block(df: DataFrame, key: str, own: str, other: str, own_blocks: int, other_blocks: int) -> DataFrame:
    """Assign each row to one block of its side and copy it to every block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_blocks))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)).cast("array<bigint>")))


def blocked_top_k(queries: DataFrame, corpus: DataFrame, keep: int, sparse: bool = True) -> DataFrame:
    """(dataset, qkey, ckey, sim): the ``keep`` most similar keys per query key of the same dataset.

    A corpus of at most BLOCK_ROWS keys is one block, which all queries are compared with. A larger one is
    cut into pivot cells, and only those that can hold a neighbour are compared; the rows are the same.
    """
    if corpus.limit(BLOCK_ROWS + 1).count() > BLOCK_ROWS:
        return cells.cell_top_k(queries, corpus, keep, sparse).drop("compared")
    qb = max(1, -(-queries.count() // BLOCK_ROWS))
    q = _block(cells.vectors(queries, sparse), "qkey", "qb", "cb", qb, 1)
    c = _block(cells.vectors(corpus, sparse), "ckey", "cb", "qb", 1, qb)
    local = q.groupBy("dataset", "qb", "cb").cogroup(c.groupBy("dataset", "qb", "cb")).applyInPandas(
        _block_kernel(keep, sparse), "dataset string, qkey string, ckey string, first_chunk string, sim double"
    )
    rank = F.row_number().over(Window.partitionBy("dataset", "qkey").orderBy(F.desc("sim"), "first_chunk"))
    return local.withColumn("_r", rank).filter(F.col("_r") <= keep).select("dataset", "qkey", "ckey", "sim")


def _directions(corpus_vec: DataFrame, keep: int) -> DataFrame:
    """Distinct corpus directions with their size and their ``keep`` smallest chunk ids.

    The rank filter runs before the shuffle, so a direction shared by a third of the corpus sends
    ``keep`` rows per map task.
    """
    by = Window.partitionBy("dataset", "direction").orderBy("chunk_id")
    top = corpus_vec.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= keep)
    return top.groupBy("dataset", F.col("direction").alias("ckey")).agg(
        F.first("vec").alias("vec"), F.min("chunk_id").alias("first_chunk"), F.count(F.lit(1)).alias("held"),
        F.collect_list(F.struct("chunk_id", "source_window_id")).alias("members"),
    )


def top_k(queries: DataFrame, corpus: DataFrame, idf: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """(dataset, query_id, rank, similarity, chunk_id, source_window_id) in (similarity, chunk id) order.

    Similarity is the cosine at 6 places; only parallel vectors reach 1. Rows of similarity 0 count.
    """
    cvec = sparse_vectors(corpus.select("dataset", "chunk_id", "source_window_id", "text"), idf, "chunk_id").join(
        corpus.select("dataset", "chunk_id", "source_window_id"), ["dataset", "chunk_id"]
    )
    return top_k_vectors(sparse_vectors(queries, idf, "query_id"), cvec, k, exclude_self)


def top_k_vectors(queries: DataFrame, corpus: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """:func:`top_k` over (dataset, query_id, vec, direction) and (dataset, chunk_id, source_window_id, vec, direction)."""
    if k <= 0:
        return queries.limit(0).select("dataset", "query_id", F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"), F.lit("").alias("chunk_id"), F.lit("").alias("source_window_id"))
    keep = k + 1
    dirs = materialize(_directions(corpus, keep), "directions")
    qvec = materialize(queries, "queries")
    qdirs = qvec.groupBy("dataset", F.col("direction").alias("qkey")).agg(F.first("vec").alias("vec"))
    full = dirs.filter((F.col("held") >= keep) & (F.size("vec") > 0)).select("dataset", F.col("ckey").alias("qkey"))
    exact = qdirs.join(full, ["dataset", "qkey"], "left_semi").select("dataset", "qkey", F.col("qkey").alias("ckey"), F.lit(1.0).alias("sim"))
    rest = qdirs.join(full, ["dataset", "qkey"], "left_anti")
    near = blocked_top_k(rest, dirs.select("dataset", "ckey", "first_chunk", "vec"), keep)
    found = exact.unionByName(near).join(dirs.select("dataset", "ckey", "members"), ["dataset", "ckey"])
    hits = found.select("dataset", "qkey", "sim", F.inline("members"))
    best = F.row_number().over(Window.partitionBy("dataset", "qkey").orderBy(F.desc("sim"), "chunk_id"))
    hits = hits.withColumn("_r", best).filter(F.col("_r") <= keep)
    lists = hits.groupBy("dataset", "qkey").agg(F.array_sort(F.collect_list(F.struct("_r", "sim", "chunk_id", "source_window_id"))).alias("hits"))
    out = qvec.select("dataset", "query_id", F.col("direction").alias("qkey")).join(lists, ["dataset", "qkey"])
    kept = F.slice(F.filter("hits", lambda h: (h["source_window_id"] != F.col("query_id")) | F.lit(not exclude_self)), 1, k)
    return out.select("dataset", "query_id", F.posexplode(kept).alias("_i", "_h")).select(
        "dataset", "query_id", (F.col("_i") + 1).alias("rank"), F.col("_h.sim").alias("similarity"), "_h.chunk_id", "_h.source_window_id"
    )


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Top-k over dense vectors: (dataset, id, vec) on both sides, the own id left out."""
    q = queries.select("dataset", F.col("id").cast("string").alias("qkey"), "vec")
    c = corpus.select("dataset", F.col("id").cast("string").alias("ckey"), F.col("id").cast("string").alias("first_chunk"), "vec")
    near = blocked_top_k(q, c, k + 1, sparse=False).filter(F.col("qkey") != F.col("ckey"))
    rank = F.row_number().over(Window.partitionBy("dataset", "qkey").orderBy(F.desc("sim"), "ckey"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("dataset", F.col("qkey").alias("query_id"), "rank", F.col("sim").alias("similarity"), F.col("ckey").alias("chunk_id"))


def gated_retrieval(gated: DataFrame, corpus: DataFrame, idf: DataFrame, k: int = 5) -> DataFrame:
    """Evidence of the ESCALATE windows only; the gate is applied before anything is compared."""
    return top_k(build_queries(gated.filter(F.col("decision") == "ESCALATE")), corpus, idf, k)


def retrieval_diagnostics(gated: DataFrame, evidence: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: escalation and duplicate rates, similarity range, share of anomalous evidence."""
    labels = corpus.select("dataset", "chunk_id", "anomaly_label")
    ev = evidence.join(labels, ["dataset", "chunk_id"], "left").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("chunk_id").alias("unique_chunks"),
        F.min("similarity").alias("sim_min"),
        F.max("similarity").alias("sim_max"),
        F.avg("similarity").alias("sim_mean"),
        F.count_if("anomaly_label").alias("anomalous_chunks"),
    )
    base = gated.agg(F.count(F.lit(1)).alias("total_windows"), F.count_if(F.col("decision") == "ESCALATE").alias("escalated_count"))
    out = base.withColumn("_e", ev.select(F.struct(*ev.columns)).scalar()).select(*base.columns, "_e.*")
    return out.withColumn("corpus_size", corpus.agg(F.count(F.lit(1))).scalar()).select(
        "*",
        F.try_divide("escalated_count", "total_windows").alias("escalation_rate"),
        F.coalesce(F.try_divide(F.col("total_chunks") - F.col("unique_chunks"), "total_chunks"), F.lit(0.0)).alias("duplicate_retrieval_rate"),
        F.coalesce(F.try_divide("anomalous_chunks", "total_chunks"), F.lit(0.0)).alias("anomalous_evidence_ratio"),
    )


def retrieval_spread(gated: DataFrame, evidence: DataFrame, corpus: DataFrame, idf: DataFrame) -> DataFrame:
    """One row: quartiles of the similarities, self retrievals, clear rate, norms of the chunk vectors.

    Quartiles are exact and interpolated; similarities have six places, so they are counted by value.
    A chunk none of whose tokens has a weight is a zero vector and counts with norm 0.
    """
    ev = evidence.agg(
        *[F.percentile("similarity", p).alias(name) for name, p in (("sim_p25", 0.25), ("sim_median", 0.5), ("sim_p75", 0.75))],
        F.coalesce(F.try_divide(F.count_if(F.col("source_window_id") == F.col("query_id")), F.count(F.lit(1))), F.lit(0.0)).alias("self_retrieval_rate"),
    )
    norms = tfidf_weights(token_counts(corpus, "chunk_id"), idf, "chunk_id").groupBy("dataset", "chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    vectors = norms.agg(F.count_if(F.col("norm") > 0).alias("full"), F.coalesce(F.sum("norm"), F.lit(0.0)).alias("norms"))
    base = gated.agg(F.count(F.lit(1)).alias("total_windows"), F.count_if(F.col("decision") != "ESCALATE").alias("auto_clear_count"))
    out = base.withColumn("_e", ev.select(F.struct(*ev.columns)).scalar()).withColumn("_v", vectors.select(F.struct(*vectors.columns)).scalar())
    out = out.withColumn("_n", corpus.agg(F.count(F.lit(1))).scalar())
    return out.select(
        "total_windows", "auto_clear_count", F.coalesce(F.try_divide("auto_clear_count", "total_windows"), F.lit(0.0)).alias("auto_clear_rate"), "_e.*",
        (F.col("_n") - F.col("_v.full")).alias("zero_vector_count"), F.coalesce(F.try_divide("_v.norms", "_n"), F.lit(0.0)).alias("mean_vector_norm"),
    )
