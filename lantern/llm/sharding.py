"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import ranked, uniform
from lantern.runtime import cut


@dataclass(frozen=True)
class Leaf:
    """A shard, the names of its region and rack, and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """Equal shards 0 to ``shards`` - 1, filled rack by rack and region by region."""
    racks = [i // shards_per_rack for i in range(shards)]
    return [Leaf(f"region{r // racks_per_region}", f"rack{r}", i) for i, r in enumerate(racks)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard in a region of its own, so that no weight of another subtree changes and rows move only into it."""
    shard = max((x.shard for x in leaves), default=-1) + 1
    return [*leaves, Leaf(f"region+{shard}", f"rack+{shard}", shard, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """The weighted draw of the subtree ``path``: the least exponential of rate ``weight`` wins."""
    return -F.log(F.lit(1.0) - uniform(key, F.lit(path))) / F.lit(float(weight))


def _winner(key: Column, weights: dict[str, float], then: dict[str, Column]) -> Column:
    """What ``then`` gives for the child with the least draw, ties to the first in order."""
    names = [x for x, w in weights.items() if w > 0]
    if len(names) == 1:
        return then[names[0]]
    draws = {x: _draw(key, x, weights[x]) for x in names}
    least, found = F.least(*draws.values()), then[names[-1]]
    for x in reversed(names[:-1]):
        found = F.when(draws[x] == least, then[x]).otherwise(found)
    return found


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of ``key``: descend region, rack and shard by weighted hash draws.

    Each level compares one draw per child that depends on the key and the child's path alone,
    scaled by the weight below the child. A change of weights therefore moves rows only into or
    out of the subtrees whose weights change. Shards of weight 0 get nothing; null keys hash alike.
    """
    if len({x.shard for x in leaves}) != len(leaves):
        raise ValueError("shard numbers must be unique")
    if not any(x.weight > 0 for x in leaves):
        raise ValueError("no shard has weight")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for x in leaves:
        if x.weight > 0:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    by_region, region_weight = {}, {}
    for region, racks in regions.items():
        by_rack, rack_weight = {}, {}
        for rack, own in racks.items():
            path = f"{region}/{rack}"
            paths = {f"{path}/{x.shard}": x for x in own}
            by_rack[path] = _winner(key, {p: x.weight for p, x in paths.items()}, {p: F.lit(x.shard) for p, x in paths.items()})
            rack_weight[path] = sum(x.weight for x in own)
        by_region[region] = _winner(key, rack_weight, by_rack)
        region_weight[region] = sum(rack_weight.values())
    return _winner(key, region_weight, by_region).cast("int")


def assign_shards(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, its number in the shard, and its shard once one more is added.

    The law is ``key``: ``doc_id`` and the shards decide. Null texts have size 1 and a null
    checksum; null ids form one key; rows with the same id share a shard and get slots in the
    order of size and checksum; an empty table gives no rows. Only fixed-width columns are
    shuffled, never texts, and the extra columns of ``docs`` are left out.
    """
    # Texts are read once; what follows needs a few numbers a row.
    narrow = cut(docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).cast("long").alias("text_crc32"),
    ))
    placed = narrow.select(
        "*",
        F.lit("key").alias("law"),
        place(F.col("doc_id"), leaves).alias("shard"),
        place(F.col("doc_id"), grow(leaves)).alias("grown_shard"),
    )
    out = ranked(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
