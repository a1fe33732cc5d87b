"""Exact nearest neighbours and neighbours within a distance, by cells around pivots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.runtime import cut

#: Rows of a cell, as planned and at most in a task; pivots of a key; rows that a task scores at most; rows of a key that can be one cell.
CELL_ROWS, CHUNK_ROWS, PIVOTS, TASK_ROWS, WHOLE_ROWS = 500, 4_000, 1_024, 20_000, 10_000


def key_text(key: str) -> Column:
    """A key as text that is never null, so that a null key equals itself in joins."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def finite(x: Column) -> Column:
    """Whether a vector and all its components are numbers."""
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _matrix(rows: Sequence) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in rows])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences, as products would lose what near rows differ in."""
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    # Blocks that stay in the processor's cache, a dimension at a time.
    for s in range(0, len(a), block := max(1, 65_536 // max(1, len(b)))):
        for j, column in enumerate(columns):
            apart = a[s : s + block, j, None] - column
            out[s : s + block] += apart * apart
    return out


def _deal(rows: DataFrame, models: DataFrame, on: Sequence[str], run: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over the ``rows`` of each key in ``on`` and the key's one row of ``models``; heavy keys are dealt to several tasks, each with a copy of the model."""
    counts = rows.groupBy(*on).agg(F.ceil(F.count("*") / TASK_ROWS).alias("salts"))
    dealt = rows.join(counts, list(on)).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).drop("salts")
    # Names of their own, as both sides may come from one table.
    own = [f"own_{c}" for c in [*on, "salt"]]
    copies = models.join(counts, list(on)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    copies = copies.select(*[F.col(c).alias(o) for c, o in zip([*on, "salt"], own, strict=True)], *[c for c in models.columns if c not in on])

    def both(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if own.empty or model.empty:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])
        return run(own, model.iloc[0])

    return dealt.groupBy(*on, "salt").cogroup(copies.groupBy(*own)).applyInPandas(both, schema)


class Cells:
    """Points dealt to the cell of their nearest pivot, of the pivots of their key, with what bounds the way to a cell's points.

    ``points`` have ``k`` (see ``key_text``), ``id``, ``x`` and any of ``extras``. Pivots are points of the
    key in the order of a hash, one for ``CELL_ROWS`` points and ``PIVOTS`` at most, so a key's model is
    bounded; cells of more than ``CHUNK_ROWS`` points are cut into chunks. With ``whole``, a key of at most
    ``WHOLE_ROWS`` points is one cell and one chunk: each query then has one row on its way, where
    in many dimensions it would have one for nearly every cell.
    """

    def __init__(self, points: DataFrame, nearest: int = 1, extras: Sequence[str] = (), whole: bool = False):
        self.extras = tuple(extras)
        points = cut(points.select("k", "id", "x", *extras))
        kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
        sizes = points.groupBy("k").agg(F.count("*").alias("in_key"))
        small = F.col("in_key") <= (WHOLE_ROWS if whole else 0)
        size = F.when(small, WHOLE_ROWS).otherwise(CELL_ROWS)
        in_hash = Window.partitionBy("k").orderBy(F.xxhash64("x"), "id")
        first = points.withColumn("i", F.row_number().over(in_hash)).where(F.col("i") <= PIVOTS).join(sizes, "k").where((F.col("i") - 1) * size < F.col("in_key"))
        pivots = cut(first.groupBy("k").agg(F.collect_list("x").alias("pivots")))
        columns = ["k", "id", "x", *extras]

        def assign(own: pd.DataFrame, model) -> pd.DataFrame:
            d = _squares(_matrix(own["x"]), _matrix(model["pivots"]))
            cell = d.argmin(axis=1)
            return own[columns].assign(cell=cell, away=np.sqrt(d[np.arange(len(d)), cell]))

        schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cell int, away double"
        placed = cut(_deal(points, pivots, ["k"], assign, schema))
        by_distance = Window.partitionBy("k", "cell").orderBy("away")
        near = placed.select("k", "cell", "away").withColumn("i", F.row_number().over(by_distance)).where(F.col("i") <= nearest)
        balls = placed.groupBy("k", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        balls = balls.join(near.groupBy("k", "cell").agg(F.sort_array(F.collect_list("away")).alias("first")), ["k", "cell"])
        balls = balls.withColumn("chunks", F.when((F.col("n") <= WHOLE_ROWS) & F.lit(whole), 1).otherwise(F.ceil(F.col("n") / CHUNK_ROWS)).cast("int"))
        self.models = cut(balls.groupBy("k").agg(F.collect_list(F.struct("cell", "radius", "first", "chunks")).alias("balls")).join(pivots, "k"))
        chunk = F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")
        chunked = placed.join(balls.select("k", "cell", "chunks"), ["k", "cell"]).withColumn("chunk", chunk)
        self.chunks = cut(chunked.groupBy("k", "cell", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "x", *extras))).alias("held")))
        self.nearest = nearest

    def ways(self, queries: DataFrame, within: float | None = None) -> DataFrame:
        """``k, x, cell, chunk`` of every chunk that may hold a point ``within`` the distance of a query, or else one of its nearest.

        No point of a cell is nearer to the query than the plane between the cell's pivot and the query's
        own, or than its distance from the pivot less the cell's radius. The distance that the nearest
        are surely within comes from the cells around: their points' distances from the pivot, added
        to the query's own.
        """
        nearest = self.nearest

        def ways(own: pd.DataFrame, model) -> pd.DataFrame:
            pivots, x = _matrix(model["pivots"]), _matrix(own["x"])
            radius, chunks, first = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=int), np.full((len(pivots), nearest), np.inf)
            for ball in model["balls"]:
                c = ball["cell"]
                radius[c], chunks[c] = ball["radius"], ball["chunks"]
                first[c, : len(ball["first"])] = ball["first"]
            between = np.sqrt(_squares(pivots, pivots))
            cells, rows = [], []
            for s in range(0, len(x), 1_000):
                square = _squares(x[s : s + 1_000], pivots)
                d, home = np.sqrt(square), square.argmin(axis=1)
                here = np.arange(len(d))
                if within is None:
                    some = np.argsort(d, axis=1)[:, :8]
                    sums = (np.take_along_axis(d, some, 1)[:, :, None] + first[some]).reshape(len(d), -1)
                    sure = np.partition(sums, nearest - 1, axis=1)[:, nearest - 1] if sums.shape[1] >= nearest else np.full(len(d), np.inf)
                    few = np.flatnonzero(np.isinf(sure))
                    if len(few):
                        every = np.sort((d[few][:, :, None] + first[None]).reshape(len(few), -1), axis=1)
                        sure[few] = every[:, min(nearest, every.shape[1]) - 1]
                else:
                    sure = np.full(len(d), within)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (square - square[here, home][:, None]) / (2 * between[home])
                least = np.fmax(np.fmax(d - radius, 0), np.where(between[home] > 0, plane, 0))
                i, c = np.nonzero((least <= sure[:, None] * (1 + 1e-9) + 1e-9) & (radius >= 0))
                rows.append(i + s)
                cells.append(c)
            i, c = np.concatenate(rows), np.concatenate(cells)
            i, c = np.repeat(i, chunks[c]), np.repeat(c, chunks[c])
            starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (c[1:] != c[:-1]))) if len(i) else np.zeros(0, dtype=int)
            chunk = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
            return pd.DataFrame({"k": own["k"].to_numpy()[i], "x": own["x"].to_numpy()[i], "cell": c, "chunk": chunk})

        return cut(_deal(queries.select("k", "x"), self.models, ["k"], ways, "k string, x array<double>, cell int, chunk int"))

    def nearest_of(self, queries: DataFrame) -> DataFrame:
        """``k, x, near``: the nearest points of each distinct query, as structs of distance ``d``, ``id`` and extras, in order of distance and id."""
        most, extras = self.nearest, self.extras

        def meet(own: pd.DataFrame, model) -> pd.DataFrame:
            held = model["held"]
            x, points = _matrix(own["x"]), _matrix([p["x"] for p in held])
            told = [(p["id"], *(p[e] for e in extras)) for p in held]
            near = []
            for s in range(0, len(x), 500):
                d = np.sqrt(_squares(x[s : s + 500], points))
                bound = np.partition(d, most - 1, axis=1)[:, most - 1] if most < d.shape[1] else np.full(len(d), np.inf)
                for line, far in zip(d, bound, strict=True):
                    # Points come by id, so a stable sort of those up to the bound breaks ties by it.
                    j = np.flatnonzero(line <= far)
                    j = j[np.argsort(line[j], kind="stable")][:most]
                    near.append([(v, *told[c]) for v, c in zip(line[j].tolist(), j.tolist(), strict=True)])
            return own[["k", "x"]].assign(near=near)

        kinds = {f.name: f.dataType.simpleString() for f in self.chunks.schema["held"].dataType.elementType.fields}
        near = ",".join(f"{c}:{kinds[c]}" for c in ("id", *extras))
        met = _deal(self.ways(queries), self.chunks, ["k", "cell", "chunk"], meet, f"k string, x array<double>, near array<struct<d:double,{near}>>")
        return met.groupBy("k", "x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near"))

    def sums_within(self, queries: DataFrame, distance: float) -> DataFrame:
        """``k, x`` and the sum of each extra over the points within the distance of each distinct query."""
        extras = self.extras

        def meet(own: pd.DataFrame, model) -> pd.DataFrame:
            held = model["held"]
            inside = _squares(_matrix(own["x"]), _matrix([p["x"] for p in held])) <= distance * distance
            return own[["k", "x"]].assign(**{e: inside @ np.array([p[e] for p in held], dtype=np.int64) for e in extras})

        met = _deal(self.ways(queries, distance), self.chunks, ["k", "cell", "chunk"], meet, "k string, x array<double>, " + ", ".join(f"{e} long" for e in extras))
        return met.groupBy("k", "x").agg(*[F.sum(e).alias(e) for e in extras])
