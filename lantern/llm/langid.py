"""Language identification by a byte convolutional network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import lookup, slices, uniform
from lantern.runtime import cut, small_batches

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PAD = 256


@dataclass(frozen=True)
class ByteNet:
    """Byte embeddings, filters of several widths, and a softmax over ``languages``.

    ``kernel`` holds all filters as columns over ``width`` bytes; narrower ones have zero rows.
    """

    languages: tuple[str, ...]
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    window: int = 192

    @property
    def width(self) -> int:
        return self.kernel.shape[0] // self.embed.shape[1]

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """(position, window, width * embedding) of codes (position, window)."""
        x = self.embed[codes]
        return np.concatenate([x[k : k + self.window] for k in range(self.width)], axis=2)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        cols = self.columns(codes)
        n = cols.shape[1]
        peaks = (cols.reshape(-1, cols.shape[2]) @ self.kernel).reshape(self.window, -1).max(axis=0).reshape(n, -1)
        return np.maximum(peaks + self.bias, 0) @ self.dense + self.offset


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windows(text: str, window: int, width: int) -> np.ndarray:
    """Codes (window, position): the lower-cased bytes of the whole text in fixed-length windows that overlap by a filter less one."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = max(1, -(-len(data) // window))
    padded = np.full(count * window + width - 1, _PAD, dtype=np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, window + width - 1)[::window]


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over windows ``x`` (position, window) of classes ``y``; ``mask`` is 1 where filters reach."""
    n, total, width = len(y), net.kernel.shape[1], net.width
    cols = net.columns(x)
    maps = (cols.reshape(-1, cols.shape[2]) @ net.kernel).reshape(net.window, n, total)
    where = maps.argmax(axis=0)
    peaks = np.take_along_axis(maps, where[None], axis=0)[0] + net.bias
    hidden = np.maximum(peaks, 0)
    slope = softmax(hidden @ net.dense + net.offset)
    slope[np.arange(n), y] -= 1
    slope /= n
    back = (slope @ net.dense.T) * (peaks > 0)
    picked = cols[where, np.arange(n)[:, None]]  # window, filter, width * size
    embed = np.zeros_like(net.embed)
    spread = (back[:, :, None] * net.kernel.T[None]).reshape(n, total, width, -1)
    np.add.at(embed, x[where[:, :, None] + np.arange(width), np.arange(n)[:, None, None]], spread)
    embed[_PAD] = 0
    return {"dense": hidden.T @ slope, "offset": slope.sum(axis=0), "bias": back.sum(axis=0), "kernel": np.einsum("nfk,nf->kf", picked, back) * mask, "embed": embed}


def train_net(
    texts: list[str],
    labels: list[str],
    widths: tuple[int, ...] = (2, 3, 4),
    filters: int = 12,
    size: int = 6,
    window: int = 192,
    epochs: int = 6,
    batch: int = 64,
    seed: int = 7,
) -> ByteNet:
    """Fit by Adam on the windows of the labelled texts; the seed fixes the result."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    width, total = max(widths), filters * len(widths)
    codes, target = [], []
    for text, lang in zip(texts, labels, strict=True):
        own = windows(text, window, width)
        codes.append(own)
        target += [languages.index(lang)] * len(own)
    codes, target = np.concatenate(codes), np.array(target)
    mask = np.zeros((width * size, total), dtype=np.float32)
    for i, w in enumerate(widths):
        mask[: w * size, i * filters : (i + 1) * filters] = 1
    p = {
        "embed": rng.normal(0, 0.5, (257, size)).astype(np.float32),
        "kernel": (rng.normal(0, 0.4, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(total, dtype=np.float32),
        "dense": rng.normal(0, 0.2, (total, len(languages))).astype(np.float32),
        "offset": np.zeros(len(languages), dtype=np.float32),
    }
    p["embed"][_PAD] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
            grad = gradients(ByteNet(languages, window=window, **p), codes[at].T, target[at], mask)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return ByteNet(languages, window=window, **p)


def classify(net: ByteNet, texts: list[str | None], windows_at_once: int = 512) -> tuple[list[str], list[float]]:
    """The language and its probability, the mean over all windows of the whole text, weighted by their bytes."""
    known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not net.languages:
        return langs, scores
    sums = np.zeros((len(texts), len(net.languages)))
    pending, owner, held = [], [], 0

    def flush():
        codes = np.concatenate(pending)
        own = np.concatenate(owner)
        filled = (codes[:, : net.window] != _PAD).sum(axis=1)
        np.add.at(sums, own, softmax(net.logits(codes.T)) * np.maximum(filled, 1)[:, None])
        pending.clear()
        owner.clear()

    for i in known:
        own = windows(texts[i], net.window, net.width)
        for start in range(0, len(own), windows_at_once):
            part = own[start : start + windows_at_once]
            pending.append(part)
            owner.append(np.full(len(part), i))
            held += len(part)
            if held >= windows_at_once:
                flush()
                held = 0
    if pending:
        flush()
    for i in known:
        share = sums[i] / sums[i].sum()
        best = int(share.argmax())
        langs[i], scores[i] = net.languages[best], float(min(1.0, share[best]))
    return langs, scores


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learnt from: crc32 of the id's text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_languages(docs: DataFrame, per_language: int = 600, chars: int = 200, pieces: int = 4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet:
    """A net fitted on a bounded sample: of each language at most ``per_language`` documents, and of each all, or ``pieces`` of ``chars`` characters.

    A longer text is cut into ``pieces`` equal parts, each with a piece from a hashed place in it, so the whole text may be learnt from.

    Only documents that aren't held out and have a text and a language are learnt from.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    part = F.floor(F.length("text") / pieces)
    place = lambda i: (i * part + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), part - chars + 1))).cast("int") + 1
    taken = F.concat_ws(" ", *[F.substr("text", place(i), F.lit(chars)) for i in range(pieces)])
    drawn = F.when(F.length("text") <= pieces * chars, F.col("text")).otherwise(taken)
    some = (
        lookup(known, cut(counts), "lang = of", how="inner")
        .where(uniform(F.col("doc_id")) < F.lit(1.3 * per_language + 20) / F.col("n"))
        .select("doc_id", "lang", drawn.alias("text"))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= per_language).orderBy("lang", "i").toPandas()
    rows = rows[rows["text"].map(lambda t: bool(_LETTER.search(t)))]
    if rows.empty:
        none = np.zeros((0, 0), dtype=np.float32)
        return ByteNet((), none, none, none, none, none)
    return train_net(rows["text"].tolist(), rows["lang"].tolist())


def predictor(docs: DataFrame, net: ByteNet):
    """A column function from texts to ``struct<lang, score>``; texts are its only input."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [classify(sent.value, run["text"].tolist()) for run in slices(texts.to_frame("text"), "text")]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    return predict


def identify_languages(docs: DataFrame, net: ByteNet | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, from its whole text.

    The language is ``und`` with score 0 where the text is null or has no letter, or where there
    was nothing to learn from. Repeated rows are predicted alike; an empty table gives no rows;
    extra columns play no part.
    """
    net = net or fit_languages(docs, doc_id=doc_id, text=text)
    found = predictor(docs, net)(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
