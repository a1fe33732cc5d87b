"""Periodic runs of words: suffix classes united by decreasing common prefix, over ordered sets of positions."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.runtime import small_batches


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, in the pairs' order."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].ravel().astype(np.int64)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words, equal for equal runs; runs are named by doubling."""
    names, have = words, 1
    while have < width:
        step = min(have, width - have)
        names = _names(names[:-step], names[step:])
        have += step
    return names


def suffix_order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the length of the prefix that each shares with the one before it (0 for the first).

    Ranks by the first 1, 2, 4, ... names are kept until all differ; the shared prefix is found by
    going down the same ranks.
    """
    n = len(names)
    ranks = [np.unique(names, return_inverse=True)[1].ravel().astype(np.int32)]
    while ranks[-1].max() < n - 1:
        step, own = 1 << (len(ranks) - 1), ranks[-1].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = own[step:] + 1
        ranks.append(_names(own, after).astype(np.int32))
    order = np.argsort(ranks[-1])
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        for x in (a, b, shared):
            x[same] += 1 << level
    return order, np.concatenate([[0], shared])


class Classes:
    """Union-find over suffixes; each class keeps its positions in order."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.places: dict[int, list[int]] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        if x not in parent:
            parent[x] = x
            self.places[x] = [x]
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def unite(self, x: int, y: int) -> Iterator[tuple[int, int]]:
        """Joins the classes of two positions; gives the pairs that are neighbours in the new class and were in none before."""
        x, y = self.root(x), self.root(y)
        if len(self.places[x]) < len(self.places[y]):
            x, y = y, x
        large, small = self.places[x], self.places.pop(y)
        self.parent[y] = x
        if small[0] > large[-1]:
            yield large[-1], small[0]
            large.extend(small)
            return
        before = -1
        for i, p in enumerate(small):
            at = bisect_left(large, p)
            if at and large[at - 1] != before:
                yield large[at - 1], p
            if at < len(large) and (i + 1 == len(small) or small[i + 1] > large[at]):
                yield p, large[at]
            insort(large, p, at, at)
            before = p


def periodic_runs(words: np.ndarray, shortest: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``shortest`` words and ``times`` periods, by start and period.

    In a run of length n and smallest period q, the suffixes at its start and q words on share exactly
    n - q words, and no suffix that begins between them shares as much. So they become neighbours when
    classes are united at that length, and each run is seeded once, by its leftmost pair. As n - q is at
    least ``shortest`` * (``times`` - 1) / ``times``, only places whose windows of that width occur
    again are sorted; other stretches are one mark each, which equals nothing.
    """
    least = -(-shortest * (times - 1) // times)
    if len(words) < max(shortest, least + 1):
        return []
    names = windows(words, least)
    again = np.bincount(names)[names] > 1
    place = np.flatnonzero(again)
    if not len(place):
        return []
    # A mark after every stretch of places; marks are larger than any name and differ from each other.
    ends = np.flatnonzero(np.append(np.diff(place) != 1, True)) + 1
    own = np.insert(names[place], ends, int(names.max()) + 1 + np.arange(len(ends)))
    at = np.insert(place, ends, -1)
    order, shared = suffix_order(own)
    near = np.flatnonzero(shared)
    near = near[np.argsort(-shared[near], kind="stable")]
    left, right, common = at[order[near - 1]].tolist(), at[order[near]].tolist(), (shared[near] + least - 1).tolist()
    classes, runs = Classes(), []
    for x, y, length in zip(left, right, common, strict=True):
        for p, q in classes.unite(x, y):
            period = q - p
            if period * (times - 1) <= length and period + length >= shortest and (p == 0 or words[p - 1] != words[q - 1]):
                runs.append((p, period + length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words with one blank between them, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in each tenth document by the checksum of its id; a null id has none.

    Fixed: the tail begins at word a = g % n and repeats the first 1 + (n - a) // (3 + g % 8) words of it,
    where g is the checksum's tenth part.
    """
    if doc_id is None or not words:
        return words
    g, apart = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if apart:
        return words
    n = len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // period)
    return words[:a] + (words[a : a + period] * times)[: n - a]


def find_runs(
    docs: DataFrame,
    shortest: int = 24,
    times: int = 3,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: the periodic runs of words of its whole text, and the text without their repeats.

    Words are what blanks and the controls 9 to 13 part, and equal only byte for byte. A run is a
    stretch with a smallest period that no neighbouring word extends, of at least ``shortest`` words
    and ``times`` periods; ``runs`` holds ``start, length, period`` by start and period. Of each run,
    ``collapsed`` keeps the first period, unless another run takes it. ``edit`` may change a row's
    words before the search.

    A text is searched where it lies, in memory that follows its own length; nothing is shuffled. Null
    and blank texts have no words and no runs; repeated rows give a row each, null ids stay null, an
    empty table gives no rows, and other columns play no part.
    """
    small_batches(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, offsets, kept = [], [0], []
            columns = array("q"), array("q"), array("q")
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes.split() parts at the contract's six bytes and at no others.
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                words = words if edit is None else edit(own, words)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                runs = periodic_runs(ids, shortest, times)
                for column, part in zip(columns, zip(*runs, strict=True), strict=False):
                    column.extend(part)
                n_words.append(len(words))
                offsets.append(len(columns[0]))
                kept.append(collapsed(words, runs))
            parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of the greatest exponent, and checksums of all runs and of the collapsed text.

    Exponents are compared as products of whole numbers, so ties are exact: the smallest start, then
    the smallest period, wins.
    """
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")

    def greater(best, r):
        # Runs come by start and period, so only a strictly greater one takes the place.
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), greater)
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
