"""Quality by hierarchical empirical Bayes: text evidence, and host and path posteriors shrunk toward their priors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import lookup, slices
from lantern.llm.text import Words
from lantern.runtime import cut, small_batches, written

#: Byte classes: lower, upper, digit, mark, bang, bar, other ASCII, beyond ASCII, blank.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[ord(c) for c in "*$%&#@^~_<>{}[]\\="]] = 3
_CLASS[ord("!")], _CLASS[ord("|")] = 4, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 8
FEATURES = 17


def features(texts: list[str | None]) -> np.ndarray:
    """One row of shares and logarithms for each text: byte classes, word lengths and repetition."""
    words = Words(texts)
    shingles, at = words.shingles(5)
    length = words.ends - words.starts
    classes = _CLASS[words.data]
    out = np.zeros((len(texts), FEATURES))
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        n = b - a
        if not n:
            continue
        counts = np.bincount(classes[words.begins[i] : words.begins[i + 1] - 1], minlength=9)
        own, runs = words.hashes[a:b], shingles[at[i] : at[i + 1]]
        _, times = np.unique(own, return_counts=True)
        out[i, :9] = counts / max(1, counts.sum())
        out[i, 9] = np.log1p(n)
        out[i, 10] = length[a:b].mean() / 10
        out[i, 11] = len(times) / n
        out[i, 12] = times.max() / n
        out[i, 13] = (own[1:] == own[:-1]).mean() if n > 1 else 0
        out[i, 14] = 1 - len(np.unique(runs)) / len(runs)
        out[i, 15] = counts[1] / max(1, counts[0] + counts[1])
        out[i, 16] = (counts[3] + counts[4] + counts[5]) / n
    return out


@dataclass(frozen=True)
class TextModel:
    """A logistic regression on scaled features; ``base`` is the share of good documents it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(z)), z]) @ self.weights, -30, 30))), 1e-4, 1 - 1e-4)


def fit_text_model(x: np.ndarray, good: np.ndarray, penalty: float = 0.05, rounds: int = 25) -> TextModel:
    """Penalised logistic regression by Newton steps; without both classes every text gets their share."""
    width = FEATURES
    if not len(x) or good.min() == good.max():
        base = float(np.clip(good.mean() if len(good) else 0.5, 1e-4, 1 - 1e-4))
        weights = np.zeros(width + 1)
        weights[0] = np.log(base / (1 - base))
        return TextModel(np.zeros(width), np.ones(width), weights, base)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    weights, ridge = np.zeros(width + 1), np.diag([0.0] + [penalty * np.sqrt(len(x))] * width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge, z.T @ (good - p) - ridge @ weights)
        weights = weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return TextModel(mean, scale, weights, float(good.mean()))


def text_probability(docs: DataFrame, model: TextModel):
    """A column function from texts to the probability of good quality; null for texts without a word."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for run in slices(texts.to_frame("text"), "text"):
                x = features(run["text"].tolist())
                found.append(pd.Series(np.where(x[:, 9] > 0, sent.value.probability(x), np.nan)))
            yield pd.concat(found, ignore_index=True) if found else pd.Series([], dtype=float)

    return probability


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        parts = [pd.Series(list(features(run["text"].tolist()))) for run in slices(texts.to_frame("text"), "text")]
        yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text", good: str = "quality") -> TextModel:
    """A text model from at most ``sample`` labelled documents, those of the least hash of their id.

    An id that is labelled more than once counts by the mean of its labels.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(good).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(good) >= 0.5).cast("double").alias("good"))
    marks = marks.orderBy(F.xxhash64("id")).limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    # At most `sample` ids, so the broadcast is bounded.
    rows = texts.join(F.broadcast(marks), "id").select("id", "good", _features("text").alias("x")).orderBy("id", "x").limit(2 * sample).toPandas()
    return fit_text_model(np.stack(rows["x"]) if len(rows) else np.zeros((0, FEATURES)), rows["good"].to_numpy(dtype=float))


def _concentration(stats: DataFrame) -> float:
    """Of a Beta prior over sites, by moments: how many documents' evidence the prior is worth."""
    # Per site: n documents and the sum of their probabilities.
    total = stats.agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count("*").alias("sites")).first()
    if not total["n"] or total["sites"] < 2:
        return 1000.0
    mean = total["p"] / total["n"]
    between = stats.agg(F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") - mean, 2)).alias("b")).first()["b"] / total["n"]
    within = total["sites"] * max(mean * (1 - mean), 1e-9) / total["n"]
    spread = max(between - within, 1e-6)
    return float(min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0))


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def score_quality(docs: DataFrame, model: TextModel, host: Column, path: Column, text: str = "text", keep_at: float = 0.5, keep: Sequence[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns of ``docs`` or of those in ``keep``, with ``text_p, host_p, path_p, quality_p, quality_keep``.

    The text model gives each document a probability. Sums per host and per path under a host give
    posterior means: a host is shrunk toward the mean of all documents, a path toward its host, each
    by the concentration that the moments of the sites show, and both without the document's own
    evidence. The path's posterior then takes the place of the global prior in the document's odds.
    Sums are aggregated before they are shuffled, so a site of any size is one row per task.

    Texts that are null or without a word have no evidence: ``text_p`` is null, they add nothing to
    their site, ``quality_p`` is 0, and they aren't kept. A null host or path is a site of its own.
    Repeated rows count as rows. An empty table gives no rows. Columns of any name stay whole in ``row``.
    """
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    scored = docs.select(row, host.alias("__host"), path.alias("__path"), text_probability(docs, model)(F.col(text)).alias("text_p"))
    # The model scores each text once: sums read two short columns of what is written, rows all of it.
    scored = written(scored.withColumn("text_p", F.nanvl("text_p", F.lit(None).cast("double"))))
    known = scored.where("text_p is not null").groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("text_p").alias("p"))
    paths = cut(known)
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    mean = total["p"] / total["n"] if total["n"] else model.base
    of_host, of_path = _concentration(hosts), _concentration(paths)
    sites = paths.alias("a").join(hosts.alias("b"), F.expr("a.__host <=> b.__host")).select(
        F.col("a.__host").alias("__h"), F.col("a.__path").alias("__q"), F.col("a.n").alias("__np"), F.col("a.p").alias("__sp"), F.col("b.n").alias("__nh"), F.col("b.p").alias("__sh")
    )
    own = F.coalesce("text_p", F.lit(0.0))
    one = F.when(F.col("text_p").isNull(), 0).otherwise(1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = lookup(scored, cut(sites), "__host <=> __h and __path <=> __q")
    with_host = joined.withColumn("host_p", (zero("__sh") - own + of_host * mean) / (zero("__nh") - one + of_host))
    with_path = with_host.withColumn("path_p", (zero("__sp") - own + of_path * F.col("host_p")) / (zero("__np") - one + of_path))
    odds = _logit(F.col("text_p")) + _logit(F.col("path_p")) - _logit(F.lit(float(mean)))
    final = with_path.withColumn("quality_p", F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.0)))
    return final.withColumn("quality_keep", F.col("quality_p") >= keep_at).drop("__host", "__path", "__h", "__q", "__np", "__sp", "__nh", "__sh")
