"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.topk import matrix, usable
from lantern.operators.components import connected_components, union_find
from lantern.runtime import cut, lookup


def learn_rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are balanced binary codes (iterative quantisation).

    The projection is the leading principal directions times the rotation that brings the
    projected rows nearest to their own signs, found by alternating signs and a Procrustes fit.
    """
    mean = sample.mean(axis=0)
    _, directions = np.linalg.eigh((sample - mean).T @ (sample - mean))
    basis = directions[:, ::-1][:, :bits]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    flat = (sample - mean) @ basis
    for _ in range(rounds):
        codes = np.where(flat @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(flat.T @ codes)
        rotation = u @ v
    return mean, basis @ rotation


def agreements(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float, pairs: int = 2_000, seed: int = 0) -> np.ndarray:
    """(pair, bit): whether the codes of pairs whose cosine is just ``threshold`` agree.

    Half of the pairs go from a row of the sample in a direction drawn evenly, half in the direction
    of another row; codes are of centred rows, so how often bits agree depends on the mean that rows
    share and can't be told from the angle alone.
    """
    rng = np.random.default_rng(seed)
    one = sample[rng.integers(len(sample), size=pairs)]
    way = sample[rng.integers(len(sample), size=pairs)] - one
    lost = (np.arange(pairs) % 2 == 0) | (np.linalg.norm(way, axis=1) < 1e-9)
    way[lost] = rng.standard_normal((int(lost.sum()), sample.shape[1]))
    way -= (way * one).sum(axis=1, keepdims=True) * one
    norm = np.linalg.norm(way, axis=1, keepdims=True)
    other = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * way / np.maximum(norm, 1e-12)
    return ((one - mean) @ projection >= 0) == ((other - mean) @ projection >= 0)


def table_plan(sample: np.ndarray, rows_per_label: float, threshold: float, recall: float, per_bucket: int = 16, most: int = 160) -> tuple[int, int, list]:
    """Bits per table, number of tables, and the rotations whose codes they are cut from.

    Rotations are added until the share ``recall`` of pairs at the threshold agrees in all bits of one
    table, measured on pairs made from the sample. Tables start as wide as buckets of ``per_bucket``
    rows ask; where more than ``most`` of them would be needed they become narrower, which keeps
    recall and costs larger buckets. Without any bits, all rows of a label meet.
    """
    bits = min(sample.shape[1], 64)
    made: list[tuple[np.ndarray, np.ndarray]] = []
    agree: list[np.ndarray] = []
    width = int(min(bits, max(6, round(math.log2(max(2.0, rows_per_label / per_bucket))))))
    for width in range(width, 0, -1):
        met, tables = 0.0, 0
        apart = None
        for r in range(-(-most // (bits // width))):
            if r == len(made):
                made.append(learn_rotation(sample, bits, r))
                agree.append(agreements(sample, *made[r], threshold))
            for i in range(0, bits - width + 1, width):
                own = ~agree[r][:, i : i + width].all(axis=1)
                apart = own if apart is None else apart & own
                tables += 1
                # The half of the pairs that meets less often decides.
                met = 1 - max(apart[::2].mean(), apart[1::2].mean())
                if met >= recall:
                    return width, tables, made[: r + 1]
            if r == 1 and met < recall * 0.15:
                break  # far from it: narrower tables at once
    return 0, 1, []


def _encoder(value, width: int, kind, dim: int):
    code = np.int16 if width < 16 else np.int32 if width < 32 else np.int64

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotations, tables = value()
        powers = 1 << np.arange(width, dtype=np.int64)
        for pdf in frames:
            x = matrix(pdf["embedding"], dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = [] if rotations else [np.zeros(len(x), dtype=np.int64)]
            for mean, projection in rotations:
                signs = (x - mean) @ projection >= 0
                keys += [signs[:, i : i + width] @ powers for i in range(0, signs.shape[1] - width + 1, width)]
            keys = np.stack(keys[:tables], axis=1)
            yield pdf[["label", "rep", "mult"]].assign(vector=[np.asarray(v, kind).tobytes() for v in pdf["embedding"]], codes=[k.tobytes() for k in keys.astype(code)], buckets=list(keys))

    return encode


def _unit(vectors: pd.Series, kind, dim: int) -> np.ndarray:
    """Rows of float64 of length 1 from the bytes of vectors, shorter ones padded with zeros."""
    lengths = vectors.map(len).to_numpy() // np.dtype(kind).itemsize
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim) < lengths[:, None]] = np.frombuffer(b"".join(vectors), dtype=kind)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _pairs_in(rep, mult, side, keys, unit, between: bool, threshold: float):
    """Linked pairs of one cell, and those that no earlier table, whose ``keys`` are given, has found."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    if between:
        i, j = np.nonzero(unit[a] @ unit[b].T >= threshold)
        i, j = a[i], b[j]
    else:
        i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    new = ~(keys[i] == keys[j]).any(axis=1)
    links = np.zeros(len(rep), dtype=np.int64)
    np.add.at(links, i[new], mult[j[new]])
    np.add.at(links, j[new], mult[i[new]])
    roots = union_find(rep[i].tolist(), rep[j].tolist())
    own = np.array(list(roots.keys()), dtype=np.int64)
    at_rep = dict(zip(rep.tolist(), links.tolist(), strict=True))
    return own, [at_rep[x] for x in roots], list(roots.values())


def _reranker(dim: int, width: int, kind, threshold: float):
    """Cells come sorted by their key; a cell may go over several frames."""
    code = np.int16 if width < 16 else np.int32 if width < 32 else np.int64

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in _with_end(frames):
            last = pdf is None
            if not last:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rest is None or rest.empty:
                continue
            cell = rest[["label", "at", "bucket", "low", "high"]].to_numpy()
            edges = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            stop = len(rest) if last else (edges[-1] if len(edges) else 0)
            if not stop:
                continue
            done, rest = rest.iloc[:stop], rest.iloc[stop:].reset_index(drop=True)
            bounds = [0, *edges[edges < stop].tolist(), stop]
            unit = _unit(done["vector"], kind, dim)
            rep, mult = done["rep"].to_numpy(), done["mult"].to_numpy()
            side, at = (done["cell"] != done["low"]).to_numpy().astype(int), done["at"].to_numpy()
            codes = done["codes"].tolist()
            two = (done["low"] != done["high"]).to_numpy()
            out = ([], [], [])
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s > 1:
                    keys = np.frombuffer(b"".join(codes[s:e]), dtype=code).reshape(e - s, int(at[s]))
                    for have, new in zip(out, _pairs_in(rep[s:e], mult[s:e], side[s:e], keys, unit[s:e], bool(two[s]), threshold), strict=True):
                        have.extend(new)
            yield pd.DataFrame({"rep": out[0], "links": out[1], "root": out[2]}, dtype="int64")

    return rerank


def _with_end(frames):
    yield from frames
    yield None


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.995,
    sample: int = 10_000,
    cell_rows: int = 1_500,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links are pairs of one label with cosine >= ``threshold``.

    Equal vectors of a label, told by 128 bits of hash, are first folded into one with a count. Rotations are learnt on at
    most ``sample`` rows (those of the least hash); signs of the rotated rows are codes, whose
    pieces are the keys of Hamming tables. Rows that meet in a bucket are compared by the cosine of
    their original vectors in double precision, so no pair below the threshold is linked; a pair
    at the threshold meets with probability ``recall``, by the count of tables that ``table_plan``
    measures on the sample. Buckets over ``cell_rows`` are cut into cells that are compared cell by
    cell, so that no task gets a whole bucket and no pairs are emitted: each cell gives link counts
    and a forest. A pair counts in the first table in which it meets. A row goes once to each table
    as the bytes of its vector and of its codes in earlier tables; its class finds it by the hash.

    Vectors that are null, zero or hold null or non-finite components, and null labels, link with
    nothing and are their own component. Repeated rows are vectors of their own and link with each
    other. Shorter vectors are padded with zeros. Extra columns are left out.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).cast("long").alias("label"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")})
    same = ["label", "h1", "h2"]
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    valid = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).where((square > 0) & (square < float("inf")))
    folded = cut(valid.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")))
    shape = folded.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).alias("dim")).first()
    if not shape["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = shape["dim"]
    fit = matrix(folded.select("embedding").orderBy(F.xxhash64("rep")).limit(sample).toPandas()["embedding"], dim)
    fit /= np.linalg.norm(fit, axis=1, keepdims=True)
    width, tables, rotations = table_plan(fit, shape["n"] / shape["labels"], threshold, recall)
    kind = np.float32 if folded.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    sent = df.sparkSession.sparkContext.broadcast((rotations, tables))
    coded = folded.mapInPandas(_encoder(lambda: sent.value, width, kind, dim), "label long, rep long, mult long, vector binary, codes binary, buckets array<long>")
    placed = coded.select("label", "rep", "mult", "vector", "codes", F.posexplode("buckets").alias("at", "bucket"))
    placed = placed.withColumn("codes", F.substring("codes", F.lit(1), F.col("at") * (2 if width < 16 else 4 if width < 32 else 8)))
    big = cut(placed.groupBy("label", "at", "bucket").count().where(F.col("count") > cell_rows).select(
        F.col("label").alias("__l"), F.col("at").alias("__a"), F.col("bucket").alias("__b"), F.ceil(F.col("count") / cell_rows).alias("cells")
    ))
    # Few buckets are big, so the rows are shuffled once, to their cells.
    cells = lookup(placed, big, "label = __l and at = __a and bucket = __b").withColumn("cells", F.coalesce("cells", F.lit(1))).drop("__l", "__a", "__b")
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    cells = cells.withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other")).drop("other", "cells")
    where = ["label", "at", "bucket", "low", "high"]
    met = cells.repartition(*where).sortWithinPartitions(*where).mapInPandas(_reranker(dim, width, kind, threshold), "rep long, links long, root long")
    met = cut(met.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(met, "rep", "root")
    per_rep = (
        folded.join(links, "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*same, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.drop("embedding").join(per_rep, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
