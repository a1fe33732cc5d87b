"""Exact top-k inner products by three-phase uniform thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.runtime import cut


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, ints``: floor(scale * component) of every usable vector, components as doubles."""
    ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return df.where(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("ints")).where("vec_id is not null")


def matrix(rows: pd.Series, dim: int) -> np.ndarray:
    """Arrays as rows of float64, shorter ones padded with zeros."""
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _partials(frames: Iterator[pd.DataFrame], ids: np.ndarray, queries: np.ndarray, lists: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: their ids, and the local scores of each list, row and query; the query's own row is -inf."""
    dim = queries.shape[1]
    cuts = np.linspace(0, dim, lists + 1).astype(int)
    step = max(1, (1 << 20) // max(1, len(ids)))
    for pdf in frames:
        for start in range(0, len(pdf), step):
            run = pdf.iloc[start : start + step]
            x, own = matrix(run["ints"], dim), run["vec_id"].to_numpy()
            scores = np.stack([x[:, a:b] @ queries[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)])
            scores[:, own[:, None] == ids[None, :]] = -np.inf
            yield own, scores


def _leaders(value: Callable, k: int) -> Callable:
    """Phase 1: the k best totals among the leaders of the local lists, and the least local scores."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries, lists = value()
        best = np.full((0, len(ids)), -np.inf)
        lows = np.full((lists, len(ids)), np.inf)
        for _, scores in _partials(frames, ids, queries, lists):
            total = scores.sum(axis=0)
            n = total.shape[0]
            lows = np.minimum(lows, np.where(np.isinf(scores), np.inf, scores).min(axis=1))
            chosen = np.zeros(total.shape, dtype=bool)
            for own in scores:
                top = np.argpartition(-own, min(k, n) - 1, axis=0)[:k]
                np.put_along_axis(chosen, top, True, axis=0)
            best = -np.sort(-np.concatenate([best, np.where(chosen, total, -np.inf)]), axis=0)[:k]
        if len(best):
            yield pd.DataFrame(
                {
                    "query_id": ids,
                    "scores": [[int(v) for v in col if np.isfinite(v)] for col in best.T],
                    "lows": [[None if np.isinf(v) else int(v) for v in col] for col in lows.T],
                }
            )

    return local


def _resolve(value: Callable, k: int) -> Callable:
    """Phases 2 and 3: entries over the uniform threshold, bounded, then resolved exactly; the k best of the partition."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries, lists, cutoff, lows = value()
        threshold = np.floor(lows + (cutoff - lows.sum(axis=0)) / lists)
        kept = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        for own, scores in _partials(frames, ids, queries, lists):
            seen = scores >= threshold[:, None, :]
            bound = np.where(seen, scores, threshold[:, None, :]).sum(axis=0)
            row, query = np.nonzero(seen.any(axis=0) & (bound >= cutoff))
            total = scores[:, row, query].sum(axis=0)
            good = (total >= cutoff[query]) & np.isfinite(total)
            found = pd.DataFrame({"query_id": ids[query[good]], "vec_id": own[row[good]], "score": total[good].astype("int64")})
            kept = pd.concat([kept, found]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield kept

    return local


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, queries_at_once: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products, ties to smaller ``vec_id``.

    ``vectors`` and ``queries`` hold ``vec_id`` and integer ``ints``. The dimensions are cut into
    ``lists`` blocks; a block's partial products are one local score list of a query. Phase 1
    gathers the leaders of the local lists of every partition; their k-th best total is a cutoff
    that the true k-th best can't be under. Phase 2 broadcasts it: a row whose total reaches the
    cutoff reaches the uniform threshold, the cutoff's share over the lists' least scores, in one
    list at least, and its upper bound from the lists reaches the cutoff. Phase 3 resolves the rows
    that are left exactly. Only leaders and resolved rows are shuffled, never the scores.

    Queries go by chunks of at most ``queries_at_once``, which bounds what is broadcast. A query is
    held against every row but those of its own id. Repeated equal rows count once; of a query id
    with different vectors the least vector asks. Shorter vectors are padded with zeros. Without
    candidates or queries there are no rows. Scores are exact below 2**53.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    # Rows are read twice for each chunk of queries.
    rows = cut(vectors.select("vec_id", "ints").distinct())
    asked = queries.groupBy("vec_id").agg(F.min("ints").alias("ints"))
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("ints")).alias("dim")).union(rows.agg(F.count("*"), F.max(F.size("ints")))).collect()
    count, dim = shape[0]["n"], max(x["dim"] or 0 for x in shape)
    if not count or not shape[1]["n"]:
        return spark.createDataFrame([], schema)
    chunks = -(-count // queries_at_once)
    while True:
        chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks))
        if asked.groupBy(chunk.alias("c")).count().agg(F.max("count")).first()[0] <= queries_at_once:
            break
        chunks *= 2

    def one(c: int) -> DataFrame:
        own = asked.where(chunk == c).orderBy("vec_id").toPandas()
        if own.empty:
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        ids, wanted = own["vec_id"].to_numpy(), matrix(own["ints"], dim)
        sent = spark.sparkContext.broadcast((ids, wanted, lists))
        leaders = rows.mapInPandas(_leaders(lambda: sent.value, k), "query_id long, scores array<long>, lows array<long>")
        lows = F.array(*[F.min(F.col("lows")[b]) for b in range(lists)])
        safe = leaders.groupBy("query_id").agg(F.try_element_at(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), F.lit(k)).alias("cutoff"), lows.alias("lows"))
        with_cut = safe.orderBy("query_id").toPandas().set_index("query_id").reindex(ids)
        least = np.array([[np.nan if v is None else v for v in x] if isinstance(x, (list, np.ndarray)) else [np.nan] * lists for x in with_cut["lows"]], dtype=float).T
        least = np.where(np.isnan(least), 0.0, least)
        # Fewer than k candidates: every row reaches the sum of the least scores.
        cutoff = np.where(with_cut["cutoff"].isna(), least.sum(axis=0), with_cut["cutoff"].astype(float))
        second = spark.sparkContext.broadcast((ids, wanted, lists, cutoff, least))
        return rows.mapInPandas(_resolve(lambda: second.value, k), "query_id long, vec_id long, score long")

    found = reduce(DataFrame.union, [one(c) for c in range(chunks)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
