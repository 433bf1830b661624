"""Diverse evidence selection (maximal marginal relevance) inside one row per query.

A query has at most retrieval_k candidates, so its candidates and their pair similarities are
small arrays and the greedy passes are column expressions; queries run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot_sparse(a: Column, b: Column) -> Column:
    other = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["weight"] * F.coalesce(F.element_at(other, e["token"]), F.lit(0.0)))


def _dot_dense(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column, sparse: bool = False) -> Column:
    """Cosine of two vectors at 6 places, clipped; 0 if one has no length."""
    dot = _dot_sparse if sparse else _dot_dense
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(dot(a, b) / n, 6)))).otherwise(F.lit(0.0))


def candidate_sets(candidates: DataFrame, sparse: bool = False) -> DataFrame:
    """One row per (dataset, query): ordered candidates and their pair similarities."""
    item = F.struct("rank", "similarity", "chunk_id", "source_window_id", "vec")
    sets = candidates.groupBy("dataset", "query_id").agg(F.array_sort(F.collect_list(item)).alias("cands"))
    sets = sets.withColumn("pair_sims", F.transform("cands", lambda x: F.transform("cands", lambda y: cosine(x["vec"], y["vec"], sparse))))
    slim = F.transform("cands", lambda c: c.dropFields("vec"))
    return sets.withColumn("cands", slim)


def mmr_picks(sets: DataFrame, evidence_k: int = 3, lam: float | Column = 0.7, retrieval_k: int | None = None) -> DataFrame:
    """Add ``picks``: (i, score, penalty) in selection order.

    The first pick is the most relevant; later ones maximise lam*rel - (1-lam)*max similarity to
    the picks so far. Ties go to the higher relevance, then to the smaller chunk id.
    """
    if retrieval_k is not None and evidence_k > retrieval_k:
        raise ValueError("evidence_k cannot exceed retrieval_k")
    weight = lam if isinstance(lam, Column) else F.lit(float(lam))
    none = F.array().cast("array<struct<i:int,score:double,penalty:double>>")
    # the matrix travels in the state, so it is computed once and not at every access
    start = F.struct(none.alias("picks"), F.col("pair_sims").alias("sims"))

    def step(state: Column, _: Column) -> Column:
        picked = state["picks"]

        def scored(i: Column) -> Column:
            c = F.get("cands", i)
            penalty = F.array_max(F.transform(picked, lambda p: F.get(F.get(state["sims"], i), p["i"])))
            score = F.when(F.size(picked) == 0, c["similarity"]).otherwise(F.round(weight * c["similarity"] - (1.0 - weight) * penalty, 9))
            return F.struct((-score).alias("ns"), (-c["similarity"]).alias("nr"), c["chunk_id"].alias("id"), i.alias("i"), F.coalesce(penalty, F.lit(0.0)).alias("penalty"))

        left = F.filter(F.sequence(F.lit(0), F.size("cands") - 1), lambda i: ~F.exists(picked, lambda p: p["i"] == i))
        best = F.transform(F.slice(F.array_sort(F.transform(left, scored)), 1, 1), lambda b: F.struct(b["i"].alias("i"), (-b["ns"]).alias("score"), b["penalty"].alias("penalty")))
        return F.struct(F.concat(picked, best).alias("picks"), state["sims"].alias("sims"))

    return sets.withColumn("picks", F.aggregate(F.sequence(F.lit(1), F.lit(evidence_k)), start, step, lambda s: s["picks"]))


def selected_rows(picked: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per selected candidate with ranks, scores and redundancy penalty."""
    rows = picked.select("dataset", "query_id", *extra, "cands", F.posexplode("picks").alias("_r", "_p"))
    c = F.get("cands", F.col("_p.i"))
    return rows.select(
        "dataset", "query_id", *extra,
        (F.col("_r") + 1).alias("selected_rank"),
        c["chunk_id"].alias("chunk_id"),
        c["source_window_id"].alias("source_window_id"),
        c["rank"].alias("retrieval_rank"),
        c["similarity"].alias("retrieval_score"),
        F.col("_p.score").alias("selection_score"),
        F.col("_p.penalty").alias("redundancy_penalty"),
    )


def _mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)).otherwise(F.lit(0.0))


def _pairs(index: Column) -> Column:
    """Similarities of all pairs of an index array, each pair once."""
    left = F.transform(index, lambda a, x: F.transform(F.slice(index, x + 2, F.greatest(F.size(index) - x - 1, F.lit(0))), lambda b: F.get(F.get("pair_sims", a), b)))
    return F.flatten(left)


def selection_metrics(picked: DataFrame, retrieval_k: int, extra: Sequence[str] = ()) -> DataFrame:
    """One row per query: compression, relevance and redundancy before and after, 4 places."""
    everyone = F.sequence(F.lit(0), F.size("cands") - 1)
    chosen = F.transform("picks", lambda p: p["i"])
    cand_sim, sel_sim = _mean(F.col("cands.similarity")), _mean(F.transform(chosen, lambda i: F.get("cands", i)["similarity"]))
    cand_pair, sel_pairs = _mean(_pairs(everyone)), _pairs(chosen)
    chunks = F.transform(chosen, lambda i: F.get("cands", i)["chunk_id"])
    wins = F.transform(chosen, lambda i: F.get("cands", i)["source_window_id"])

    def r4(c: Column) -> Column:
        return F.round(c, 4)

    return picked.select(
        "dataset", "query_id", *extra,
        F.size("cands").alias("candidate_count"),
        F.size("picks").alias("selected_count"),
        r4(F.size("picks") / F.lit(float(retrieval_k))).alias("compression_ratio"),
        r4(cand_sim).alias("mean_candidate_similarity"),
        r4(sel_sim).alias("mean_selected_similarity"),
        r4(sel_sim - cand_sim).alias("relevance_delta"),
        r4(cand_pair).alias("mean_pairwise_candidate_similarity"),
        r4(_mean(sel_pairs)).alias("mean_pairwise_selected_similarity"),
        r4(F.coalesce(F.array_max(sel_pairs), F.lit(0.0))).alias("max_pairwise_selected_similarity"),
        r4(cand_pair - _mean(sel_pairs)).alias("pairwise_similarity_reduction"),
        F.size(F.array_distinct(wins)).alias("unique_source_window_count"),
        F.size(F.array_distinct(chunks)).alias("unique_chunk_count"),
        (F.size("picks") - F.size(F.array_distinct(chunks))).alias("duplicate_chunk_count"),
    )


def lambda_sweep(sets: DataFrame, lambdas: Sequence[float] = (1.0, 0.85, 0.7, 0.5, 0.0), evidence_k: int = 3) -> DataFrame:
    """Mean relevance and redundancy per lambda; each query row is repeated once per lambda."""
    each = sets.withColumn("lam", F.explode(F.array(*[F.lit(v) for v in lambdas])))
    return _sweep(mmr_picks(each, evidence_k, F.col("lam")), "lam")


def budget_sweep(sets: DataFrame, budgets: Sequence[int] = (1, 3, 5), lam: float = 0.7) -> DataFrame:
    """Per evidence budget. Greedy picks are nested, so one run at the largest budget serves all."""
    run = mmr_picks(sets, max(budgets), lam)
    each = run.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    return _sweep(each.withColumn("picks", F.slice("picks", F.lit(1), F.col("budget"))), "budget")


def top_versus_mmr(sets: DataFrame, k: int = 3, lam: float = 0.7) -> DataFrame:
    """The k most relevant candidates against k diverse ones."""
    plain = F.transform(F.slice(F.sequence(F.lit(0), F.size("cands") - 1), 1, k), lambda i: F.struct(i.alias("i"), F.get("cands", i)["similarity"].alias("score"), F.lit(0.0).alias("penalty")))
    top = sets.withColumn("picks", plain).withColumn("method", F.lit("top"))
    return _sweep(top.unionByName(mmr_picks(sets, k, lam).withColumn("method", F.lit("mmr"))), "method")


def _sweep(picked: DataFrame, key: str) -> DataFrame:
    chosen = F.transform("picks", lambda p: p["i"])
    rel = F.transform(chosen, lambda i: F.get("cands", i)["similarity"])
    rows = picked.select(key, F.aggregate(rel, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(rel).alias("n"), F.round(_mean(_pairs(chosen)), 4).alias("p"))
    return rows.groupBy(key).agg(F.round(F.sum("s") / F.sum("n"), 4).alias("mean_relevance"), F.round(F.avg("p"), 4).alias("mean_pairwise_similarity"))


def reranking_diagnostics(metrics: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of before / after totals over all queries."""

    def side(df: DataFrame, name: str, sim: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_total_chunks"), F.countDistinct("chunk_id").alias(f"{name}_unique_chunks"),
            F.countDistinct("source_window_id").alias(f"{name}_unique_source_windows"), F.round(F.avg(sim), 4).alias(f"mean_{name}_similarity"),
        )

    c, s = side(candidates, "candidate", "similarity"), side(selected, "selected", "retrieval_score")
    out = metrics.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("mean_pairwise_candidate_similarity"), 4).alias("mean_candidate_pairwise_similarity"),
        F.round(F.avg("mean_pairwise_selected_similarity"), 4).alias("mean_selected_pairwise_similarity"),
    )
    out = out.withColumn("_c", c.select(F.struct("*")).scalar()).withColumn("_s", s.select(F.struct("*")).scalar())
    return out.select(*out.columns[:3], "_c.*", "_s.*").withColumn(
        "candidate_duplicate_rate", F.round(F.try_divide(F.col("candidate_total_chunks") - F.col("candidate_unique_chunks"), "candidate_total_chunks"), 4)
    ).withColumn("selected_duplicate_rate", F.round(F.try_divide(F.col("selected_total_chunks") - F.col("selected_unique_chunks"), "selected_total_chunks"), 4))
