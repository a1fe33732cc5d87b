"""Packing: optimal length buckets from the global histogram, and token-budget batches inside each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import ranked, word_count
from lantern.runtime import cut


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise the padding when a row is padded to its bucket's bound.

    Dynamic programming over the distinct lengths: the best split of the first j lengths into k
    buckets ends with one bucket over lengths i to j, padded to length j. The best i never falls as j
    grows, so each layer is solved by halves. Fewer distinct lengths than buckets give one bound each.
    """
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    m = len(size)
    if m <= buckets:
        return size.tolist()
    rows = np.concatenate([[0], np.cumsum(n)]).astype(float)
    # Padding only differs from the padded total by the tokens, which don't depend on the split.
    best = size * rows[1:]
    choice = np.zeros((buckets, m), dtype=np.int64)
    for k in range(1, buckets):
        now = best.copy()
        spans = [(0, m - 1, 0, m - 1)]
        while spans:
            a, b, low, high = spans.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(max(low, 1), min(high, j) + 1)
            at = low
            if len(i):
                cost = best[i - 1] + size[j] * (rows[j + 1] - rows[i])
                at = int(i[cost.argmin()])
                if cost.min() < now[j]:
                    now[j] = cost.min()
                    choice[k, j] = at
            spans += [(a, j - 1, low, max(at, low)), (j + 1, b, max(at, low), high)]
        best = now
    bounds, j = [], m - 1
    for k in range(buckets - 1, -1, -1):
        bounds.append(int(size[j]))
        start = choice[k, j]
        if start == 0:
            break
        j = start - 1
    return sorted(bounds)


def pieces(docs: DataFrame, length: Column, max_length: int) -> DataFrame:
    """``docs`` with ``piece, start, length``: each row cut into pieces of at most ``max_length`` tokens, one for an empty row."""
    count = F.greatest(F.lit(1), F.ceil(F.col("__n") / max_length)).cast("int")
    cut_rows = docs.withColumn("__n", length).withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = (F.col("piece") * F.lit(max_length)).cast("long")
    return cut_rows.withColumn("start", start).withColumn("length", F.least(F.col("__n") - F.col("start"), F.lit(max_length)).cast("long")).drop("__n")


def pack(
    docs: DataFrame,
    max_length: int = 2048,
    buckets: int = 8,
    budget: int = 16_384,
    length: Column | None = None,
    doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, piece, start, length, bucket, padded_length, batch, slot`` of every piece of every row.

    Rows are cut into pieces of at most ``max_length`` tokens, so the histogram has at most
    ``max_length`` + 1 rows, which is all that the driver gets. Its optimal boundaries are the
    buckets; inside a bucket, pieces in hashed order fill batches of ``budget`` // padded_length
    pieces, at least one. Numbers of batches and slots start at 0 and have no gaps, in buckets of
    any size without a task that holds one whole.

    A row's ``length`` is its number of words unless an expression is given. Null and empty texts
    give one piece of length 0 and take a padded length of 1 at least. Rows with equal ids and
    lengths are packed as rows of their own. An empty table gives no rows; extra columns are left out.
    """
    size = word_count(F.col("text")) if length is None else length
    # Texts are read once; what follows needs two numbers a row.
    narrow = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("__size")))
    cut_rows = pieces(narrow, F.col("__size"), max_length).drop("__size")
    histogram = cut_rows.groupBy("length").count().orderBy("length").toPandas()
    bounds = optimal_boundaries(histogram["length"].tolist(), histogram["count"].tolist(), buckets) or [0]
    bucket = sum((F.col("length") > b).cast("int") for b in bounds)
    placed = cut_rows.withColumn("bucket", bucket)
    padded = F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1)).cast("long")
    numbered = ranked(placed.withColumn("padded_length", padded), "bucket", ["doc_id", "piece", "length"], "__slot")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_length")))
    return numbered.select(
        "doc_id", "piece", "start", "length", "bucket", "padded_length", F.floor(F.col("__slot") / each).cast("long").alias("batch"), (F.col("__slot") % each).cast("int").alias("slot")
    )
