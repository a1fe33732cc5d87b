"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import lookup, uniform, word_count
from lantern.runtime import cut, in_order, sum_before


def water_fill(sizes: Sequence[float], weights: Sequence[float], most: float) -> list[float]:
    """Targets that share ``sum(sizes)`` by weight, none above ``most`` times its size.

    What a capped source can't take is shared again by weight among the others, until no target
    is above its cap. Sources without words get 0.
    """
    caps = [most * s for s in sizes]
    target, left, rest = [0.0] * len(sizes), float(sum(sizes)), {i for i, s in enumerate(sizes) if s > 0}
    while rest:
        share = left / sum(weights[i] for i in rest)
        full = {i for i in rest if share * weights[i] >= caps[i]}
        for i in full or rest:
            target[i] = caps[i] if full else share * weights[i]
        if not full:
            break
        left -= sum(caps[i] for i in full)
        rest -= full
    return target


def rates(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """``source, source_size, target, rate`` from ``source, source_size``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. The fill is
    solved without gathering sources: the share per unit of weight is found from the caps sorted
    by size over weight, where capped sources always come first. Sources are numbered and summed in
    cells, so that they may be as many as there are hosts.
    """
    names = in_order(sizes.withColumn("__null", F.col("source").isNull()), "__null", "source", name="__place")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(kinds, (F.pmod(F.col("__place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(names.select("source", "source_size", "__null", weight.alias("weight")))
    filled = ranked.where("source_size > 0").withColumn("__full", F.col("source_size") / F.col("weight"))
    by_level = ["__full", "__null", "source"]
    filled = sum_before(filled, [], by_level, F.col("source_size"), "__sizes")
    filled = sum_before(filled, [], by_level, F.col("weight"), "__weights")
    total = ranked.where("source_size > 0").agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__heavy"))  # one row
    # The share per weight if exactly the sources before a source were capped.
    level = (F.col("__all") - most * F.col("__sizes")) / (F.col("__heavy") - F.col("__weights"))
    # It rises while sources under it are set apart and falls afterwards: the highest is the share.
    share = filled.crossJoin(F.broadcast(total)).agg(F.max(level).alias("share"))  # one row
    target = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)) * F.col("source_size"), F.col("share") * F.col("weight"))).otherwise(F.lit(0.0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.crossJoin(F.broadcast(share)).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_counts(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: float = 3.0,
    seeds: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: bool = False,
) -> DataFrame:
    """Every document with its source's size, target and rate, and the ``n_copies`` it gets in the mix.

    Words are summed per source, targets follow from ``water_fill``'s rule, and a document is
    taken floor(rate) times plus one copy drawn from a hash of its id and a seed, with the
    fraction as probability. The seed is chosen per source: of ``seeds`` candidates, all summed
    in one aggregation, the one whose mix comes nearest the target. Reruns agree, as nothing but
    ids and sizes decides. Null or blank texts have size 0; a null source is a source of its own;
    rows with the same id and size are drawn alike; a source without words has rate 0; an empty
    table gives no rows. With ``keep`` the columns of ``docs`` come along as struct ``row``.
    """
    full = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []),
    )
    # Texts are read once for the counts; the rows themselves only once more where they are wanted.
    narrow = cut(full.select("doc_id", "source", "size"))
    table = rates(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(uniform(F.col("doc_id"), F.col("size"), seed=s) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)]
    table = cut(table)
    chosen = (
        lookup(narrow.select("doc_id", F.col("source").alias("__s"), "size"), table.select("source", fraction.alias("fraction")), "__s <=> source")
        .groupBy("source")
        .agg(*extra)
        .join(table.withColumnRenamed("source", "__t"), F.expr("source <=> __t"))
    )
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    off = F.array(*[F.struct(F.abs(F.col(f"s{s}") - wanted).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)])
    plan = cut(chosen.select("__t", "source_size", "target", "rate", F.array_min(off)["seed"].alias("seed")))
    drawn = F.shiftrightunsigned(F.xxhash64("seed", "doc_id", "size"), 11) / F.lit(float(1 << 53))
    return lookup(full if keep else narrow, plan, "source <=> __t").withColumn("n_copies", copies(F.col("rate"), drawn)).drop("__t")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` repeated as often as ``mix_counts`` says, with the same columns."""
    counted = mix_counts(docs, keep=True, **options)
    repeated = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return repeated.select("row.*")
