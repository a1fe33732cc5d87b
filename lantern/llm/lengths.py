"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.runtime import cut, small_batches

#: Fixed: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the blanks of ``PATTERN``'s ``\\s``, in runs that its matcher would have to go back over one by one.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_encodings: dict[str, object] = {}


def _encoding(ranks: bytes):
    key = hashlib.md5(ranks).hexdigest()
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def count_tokens(encoding, text: str) -> int:
    """Number of tokens of a whole text, with any runs of blanks.

    The pattern's ``\\s+(?!\\S)`` goes back from the end of a run, which overflows its matcher's stack at
    about a million blanks. It gives a run of two or more as one piece but for its last blank, which
    goes with what follows, and all of a run that ends the text. So a text can be parted there: what
    lies between long runs is encoded as it is, and a run's piece is merged without the pattern.
    """
    total, at = 0, 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counter(docs: DataFrame, vocabulary: str = VOCABULARY):
    """A column function from texts to their numbers of tokens, 0 for null.

    The driver reads the vocabulary, a file of fixed size, and sends it to the executors.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(sent.value)
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else count_tokens(encoding, t)).astype("int64")

    return count


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``length, n_docs`` of the encoded whole texts; null and empty texts have length 0, repeated rows count as rows, other columns play no part."""
    lengths = docs.select(token_counter(docs, vocabulary)(F.col(text)).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 256) -> DataFrame:
    """For every length that occurs, what a context limit of that length means, exactly.

    ``docs_over`` documents are longer; ``tokens_upto`` are the tokens of those that aren't;
    ``truncated_tokens`` are what is left of all documents cut at the limit; ``quantile`` is the
    share of documents that fit. Sums run inside blocks of ``block`` lengths and then over the
    blocks, so that no task gets the whole histogram. The histogram is cut first, as it is read
    for the rows and for the blocks. An empty histogram gives no rows.
    """
    h = cut(histogram.select("length", "n_docs")).select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / block).alias("block"))
    inside = Window.partitionBy("block").orderBy("length")
    over_blocks = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = h.groupBy(F.col("block").alias("b")).agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("bn").over(over_blocks), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bt").over(over_blocks), F.lit(0)).alias("t_before"),
        F.sum("bn").over(everything).alias("total_docs"),
        F.sum("bt").over(everything).alias("total_tokens"),
    )
    upto = h.withColumns({"n_in": F.sum("n_docs").over(inside), "t_in": F.sum("tokens").over(inside)}).join(blocks, F.col("block") == F.col("b"))
    n, t = F.col("n_in") + F.col("n_before"), F.col("t_in") + F.col("t_before")
    return upto.select(
        "length",
        "n_docs",
        (F.col("total_docs") - n).alias("docs_over"),
        t.alias("tokens_upto"),
        F.col("total_tokens"),
        (t + F.col("length") * (F.col("total_docs") - n)).alias("truncated_tokens"),
        (n / F.col("total_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context, docs_over, truncated_tokens`` for any limits: between two lengths the totals go up by one token per longer document."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context long")
    below = asked.join(sums, F.col("length") <= F.col("context"), "left").groupBy("context").agg(F.max_by(F.struct("length", "docs_over", "truncated_tokens"), "length").alias("s"))
    total = sums.agg(F.sum("n_docs").alias("docs"))
    over = F.coalesce("s.docs_over", "docs", F.lit(0))
    start = F.coalesce("s.truncated_tokens", F.lit(0))
    return below.crossJoin(F.broadcast(total)).select("context", over.alias("docs_over"), (start + (F.col("context") - F.coalesce("s.length", F.lit(0))) * over).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, length``: the least length that holds at least that share of the documents."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    return asked.join(sums, F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("length").alias("length"))
