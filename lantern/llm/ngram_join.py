"""N-gram Jaccard join by prefixes under several global orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import lookup, slices
from lantern.llm.text import Words, mix64, set_id
from lantern.operators.components import connected_components
from lantern.runtime import cut, small_batches

_DROP = np.uint64(24)
#: Bits of a token that its slice and place keep.
_BITS = 40
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Orders:
    """Several total orders of all tokens: frequent tokens come last, by how frequent they are, the others by one hash per order.

    ``hot`` holds the leading bits of the frequent tokens, sorted, and ``df`` their document counts.
    """

    hot: np.ndarray
    df: np.ndarray
    percent: int = 75
    count: int = 3

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.uint64)
        if len(self.hot):
            lead = (tokens >> _DROP) & ~np.uint64(255)  # as counted
            at = np.minimum(np.searchsorted(self.hot, lead), len(self.hot) - 1)
            same = self.hot[at] == lead
            out[same] = self.df[at[same]]
        return out

    def prefix(self, tokens: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
        """The tokens of which sets of that similarity share one: all but ceil(percent of the size) and one more, in this order.

        ``tokens`` are sorted, so that ties of the hash fall alike in every set.
        """
        n = len(tokens)
        size = n - -(-self.percent * n // 100) + 1
        rank = (np.minimum(df, np.uint64((1 << 20) - 1)) << np.uint64(44)) | (mix64(tokens + np.uint64(int(_SALT) * (order + 1) % (1 << 64))) >> np.uint64(20))
        return tokens[np.argsort(rank, kind="stable")[:size]]


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    shingles, first = Words(texts).shingles(width)
    for a, b in zip(first, first[1:], strict=False):
        yield np.unique(shingles[a:b])


def _describe(width: int):
    @F.pandas_udf("sid long, n long")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sid, n = [], []
            for run in slices(texts.to_frame("text"), "text"):
                for own in _sets(run["text"].tolist(), width):
                    sid.append(int(set_id(own)) if len(own) else None)
                    n.append(len(own))
            yield pd.DataFrame({"sid": pd.array(sid, dtype="Int64"), "n": n})

    return describe


class _Cuts:
    """Ranges of the token space, all alike wide; a token's place in its range has 32 bits."""

    def __init__(self, count: int):
        self.count = 1 << max(_BITS - 32, (count - 1).bit_length())
        self.shift = np.uint64(_BITS - (self.count.bit_length() - 1))

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = tokens >> _DROP
        at = lead >> self.shift
        return at.astype(np.int64), (lead - (at << self.shift)).astype(np.uint32)

    def lead(self, at: int, place: np.ndarray) -> np.ndarray:
        return (np.uint64(at) << self.shift) + place.astype(np.uint64)


def _unique_sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of the texts; of equal sets in a task only the first, as one stands for all."""
    seen: set[int] = set()
    for pdf in batches:
        for run in slices(pdf, "text"):
            for own in _sets(run["text"].tolist(), width):
                if len(own) and (sid := int(set_id(own))) not in seen:
                    seen.add(sid)
                    yield sid, own


def _dealt(at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """For each value of ``at``: the value and the bytes of its part of the columns, in their order."""
    order = np.argsort(at, kind="stable")
    at, columns = at[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=int)
    for s, e in zip(edges, [*edges[1:], len(at)], strict=False):
        yield (int(at[s]), *[c[s:e].tobytes() for c in columns])


def _token_places(cuts: _Cuts, width: int, flush: int = 500_000):
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out():
            at, place = cuts.of(np.concatenate(held))
            # The leading 24 of a place's 32 bits: two tokens that share them count together, which an order may.
            short = place.view(np.uint8).reshape(-1, 4)[:, 1:]
            return pd.DataFrame(_dealt(at, short), columns=["slice", "places"])

        for _, own in _unique_sets(batches, width):
            held.append(own)
            size += len(own)
            if size >= flush:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return places


def _frequent(cuts: _Cuts, most: int, least: int):
    def frequent(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["slice"].iloc[0])
        short = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, 3) for x in pdf["places"]])
        whole = np.zeros((len(short), 4), dtype=np.uint8)
        whole[:, 1:] = short
        place, df = np.unique(whole.view(np.uint32).ravel(), return_counts=True)
        keep = df >= least
        place, df = place[keep], df[keep]
        if len(place) > most:  # the most frequent ones, ties by place
            order = np.lexsort((place, -df))[:most]
            place, df = place[order], df[order]
        return pd.DataFrame({"lead": cuts.lead(at, place).astype(np.int64), "df": df.astype(np.int64)})

    return frequent


def _postings(cuts: _Cuts, orders, width: int, big: int, flush: int = 400_000):
    """The prefixes under the first order; tokens of over ``big`` documents are dealt over several salts."""

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out():
            tokens = np.concatenate([x[0] for x in held])
            df = np.concatenate([x[1] for x in held])
            lengths = [len(x[0]) for x in held]
            sid = np.repeat(np.array([x[2] for x in held], dtype=np.int64), lengths)
            spot = np.concatenate([np.minimum(np.arange(k), 65535) for k in lengths]).astype(np.uint16)
            n = np.repeat(np.array([x[3] for x in held], dtype=np.uint32), lengths)
            at, place = cuts.of(tokens)
            rows = []
            parts = np.maximum(df.astype(np.int64) // big, 0)
            salt = np.where(parts > 0, sid % (parts + 1), -1)
            for s in np.unique(salt):
                m = salt == s
                rows += [(x[0], int(s), *x[1:]) for x in _dealt(at[m], place[m], sid[m], n[m], spot[m])]
            return pd.DataFrame(rows, columns=["slice", "salt", "places", "sids", "ns", "spots"])

        value = orders.value
        for sid, own in _unique_sets(batches, width):
            df = value.frequency(own)
            first = value.prefix(own, df, 0)
            held.append((first, value.frequency(first), sid, len(own)))
            size += len(first)
            if size >= flush:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return postings


def _pair_blobs(a: np.ndarray, b: np.ndarray, deals: int) -> list[tuple]:
    """Distinct pairs, smaller id first, dealt by a hash of both."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    if len(low):
        pairs = np.unique(np.stack([low, high], axis=1), axis=0)
        low, high = pairs[:, 0], pairs[:, 1]
    at = mix64(low.astype(np.uint64) * _SALT + high.astype(np.uint64)) % np.uint64(deals)
    return [(d, x, y, None, None, None) for d, x, y in _dealt(at.astype(np.int64), low, high)]


def _may_link(percent: int, n, e, m, f):
    """Whether sets of ``n`` and ``m`` tokens can be similar: their sizes allow it, and so does what may be common.

    ``e`` and ``f`` count the tokens from the shared one on. Before the first token that two sets
    share in an order they share none, so that the lesser count bounds what they share.
    """
    needed = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(e, f) >= needed)


def _candidates(cuts: _Cuts, percent: int, small: int, deals: int):
    """Pairs of sets that share a prefix token, and the groups whose pairs are too many to list.

    Groups of at most ``small`` sets give all pairs that may link. Larger ones give each set's pair
    with the set in which the token comes earliest, the one with the fewest tokens of its own, and
    the group itself for the second round, without the sets that can't link with any of it.
    """

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        at, salted = int(pdf["slice"].iloc[0]), int(pdf["salt"].iloc[0]) >= 0
        read = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in pdf[c]])
        place, sid = read("places", np.uint32), read("sids", np.int64)
        n, spot = read("ns", np.uint32).astype(np.int64), read("spots", np.uint16).astype(np.int64)
        order = np.lexsort((sid, n, spot, place))
        place, sid, n, e = place[order], sid[order], n[order], (n - spot)[order]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (sid[1:] != sid[:-1])])
        place, sid, n, e = place[new], sid[new], n[new], e[new]
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        counts = np.diff(np.concatenate([heads, [len(place)]]))
        if not salted:
            many = counts > 1
            keep = np.repeat(many, counts)
            place, sid, n, e, counts = place[keep], sid[keep], n[keep], e[keep], counts[many]
            heads = np.cumsum(counts) - counts
        if not len(place):
            return pd.DataFrame(columns=["deal", "a", "b", "grp", "ns", "es"])
        group = np.repeat(np.arange(len(counts)), counts)
        large = counts > small if not salted else np.ones(len(counts), dtype=bool)
        left, right = [], []
        rest = np.flatnonzero(~large[group])
        g, s, size, left_over = group[rest], sid[rest], n[rest], e[rest]
        for d in range(1, small):
            if len(g) <= d:
                break
            ok = (g[d:] == g[:-d]) & _may_link(percent, size[:-d], left_over[:-d], size[d:], left_over[d:])
            left.append(s[:-d][ok])
            right.append(s[d:][ok])
        star = np.flatnonzero(large[group])
        pivot = heads[group[star]]
        ok = (star != pivot) & _may_link(percent, n[pivot], e[pivot], n[star], e[star])
        left.append(sid[pivot[ok]])
        right.append(sid[star[ok]])
        rows = _pair_blobs(np.concatenate(left), np.concatenate(right), deals)
        # The least partner that a set may have in its group shows whether it can link at all.
        least = np.maximum(np.minimum.reduceat(n, heads)[group], -(-percent * n // 100))
        able = e >= -(-percent * (n + least) // (100 + percent)) if not salted else np.ones(len(n), dtype=bool)
        listed: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(large):
            own = np.arange(heads[i], heads[i] + counts[i])
            own = own[able[own]]
            if len(own) < (1 if salted else 2):
                continue
            own = own[np.argsort(sid[own])]
            name = int(mix64(cuts.lead(at, place[own[:1]]))[0] >> np.uint64(1)) if salted else int(set_id(sid[own].astype(np.uint64)))
            seen = listed.get(name)
            listed[name] = np.stack([sid[own], n[own], e[own] if seen is None else np.maximum(seen[2], e[own])])
        rows += [(None, x[0].tobytes(), None, name, x[1].tobytes(), x[2].tobytes()) for name, x in listed.items()]
        return pd.DataFrame(rows, columns=["deal", "a", "b", "grp", "ns", "es"], dtype=object)

    return candidates


def _distinct_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    pairs = np.stack([np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf[c]]) for c in ("a", "b")], axis=1)
    pairs = np.unique(pairs, axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for grp, *blobs in zip(pdf["grp"], pdf["a"], pdf["ns"], pdf["es"], strict=True):
            sid, n, e = (np.frombuffer(x, dtype=np.int64) for x in blobs)
            yield pd.DataFrame({"grp": int(grp), "sid": sid, "n": n, "e": e})


def _between(percent: int, deals: int):
    """Pairs of each cell whose sets are in different components and alike enough in size; cells come sorted and may go over frames."""
    where = ["grp", "low", "high"]

    def pairs_of(sid, n, e, component, low_side) -> tuple[np.ndarray, np.ndarray]:
        a = np.flatnonzero(low_side)
        b = np.flatnonzero(~low_side) if not low_side.all() else a
        left, right = [], []
        for s in range(0, len(a), 512):
            part = a[s : s + 512]
            apart = component[part][:, None] != component[b][None, :]
            i, j = np.nonzero(apart & _may_link(percent, n[part][:, None], e[part][:, None], n[b][None, :], e[b][None, :]))
            left.append(sid[part[i]])
            right.append(sid[b[j]])
        return np.concatenate(left), np.concatenate(right)

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in _ended(frames):
            last = pdf is None
            if not last:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rest is None or rest.empty:
                continue
            cell = rest[where].to_numpy()
            edges = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            stop = len(rest) if last else (int(edges[-1]) if len(edges) else 0)
            if not stop:
                continue
            sid, n, left_over, component = (rest[c].to_numpy()[:stop] for c in ("sid", "n", "e", "component"))
            one_side, low_side = cell[:stop, 1] == cell[:stop, 2], (rest["cell"] == rest["low"]).to_numpy()[:stop]
            found = []
            bounds = [0, *edges[edges < stop].tolist(), stop]
            for s, e in zip(bounds, bounds[1:], strict=False):
                side = low_side[s:e]
                if one_side[s] or (side.any() and not side.all()):
                    found.append(pairs_of(sid[s:e], n[s:e], left_over[s:e], component[s:e], side))
            rest = rest.iloc[stop:].reset_index(drop=True)
            if found:
                rows = _pair_blobs(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), deals)
                yield pd.DataFrame([r[:3] for r in rows], columns=["deal", "a", "b"])

    return between


def _ended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def _wanted(width: int, orders, prefixes: bool):
    """Of the texts: set id, and either the prefixes under the second and later orders or the whole tokens."""

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = orders.value
        rows, size = [], 0
        for sid, own in _unique_sets(batches, width):
            if prefixes:
                df = value.frequency(own)
                # Half of each token is enough to filter by; the whole sets decide.
                sets = [np.unique((value.prefix(own, df, k) >> np.uint64(32)).astype(np.uint32)).tobytes() for k in range(1, value.count)]
            else:
                sets = [own.tobytes()]
            rows.append((sid, sets))
            size += len(own)
            if size > 500_000:
                yield pd.DataFrame(rows, columns=["sid", "sets"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["sid", "sets"])

    return wanted


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _share_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that share a prefix token under every one of the other orders."""
    half = lambda x: np.frombuffer(x, dtype=np.uint32)
    for pdf in batches:
        keep = [all(_common(half(p), half(q)) for p, q in zip(x, y, strict=True)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
        yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]


def _similar(percent: int):
    """Pairs whose whole sets are similar enough."""

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                p, q = np.frombuffer(x[0], dtype=np.uint64), np.frombuffer(y[0], dtype=np.uint64)
                both = _common(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return similar


def jaccard_rows(
    docs: DataFrame,
    width: int = 5,
    percent: int = 75,
    orders: int = 3,
    hot_tokens: int = 1 << 18,
    hot_from: int = 8,
    small_group: int = 4,
    big_token: int = 200_000,
    cell_rows: int = 2_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component`` for every row: the component of its shingle set, where sets of a similarity of ``percent`` / 100 or more are linked.

    ``text_key`` is a hash of the text, which with the id tells rows with different texts apart;
    ``component`` is a number that only rows of one component share, null where no other row is in it.

    1. Every text becomes its set of distinct shingles, named by a hash; rows with equal sets are one
       set from here on and link with each other.
    2. Sets are counted per token. The most frequent tokens, ``hot_tokens`` at most, come last in all
       orders; the others follow one hash per order. Similar sets share a token of their prefixes
       under every one of the orders, and passages that many texts hold are in few prefixes.
    3. Prefix tokens under the first order are dealt by token. A small group gives all its pairs, a
       large one pairs with the set in which the token comes first. Pairs must share a prefix token under all other orders;
       then whole sets are compared, exactly.
    4. In large groups, pairs of sets that the links so far don't connect follow in cells, so no task
       gets a whole group; pairs inside a component can't change it. So no link between different
       texts is lost, and copies are never expanded to all pairs.

    Tokens travel as packed arrays, a row per range of tokens and task, so what is shuffled follows
    the text, not its pairs. Texts that are null or without words have no shingles and no component.
    Extra columns are left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = cut(base.select("doc_id", F.xxhash64("text").alias("text_key"), _describe(width)("text").alias("d")).select("doc_id", "text_key", "d.sid", F.col("d.n").alias("n")))
    reps = cut(described.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")))
    total = reps.agg(F.sum("n")).first()[0] or 0
    cuts = _Cuts(max(256, total // 1_000_000))
    deals = max(64, total // 5_000_000)
    texts = base.where("text is not null").select("text")

    counted = texts.mapInPandas(_token_places(cuts, width), "slice long, places binary")
    hot = counted.groupBy("slice").applyInPandas(_frequent(cuts, max(16, 4 * hot_tokens // cuts.count), hot_from), "lead long, df long")
    hot = hot.orderBy(F.desc("df"), "lead").limit(hot_tokens).toPandas().sort_values("lead")
    shared = spark.sparkContext.broadcast(Orders(hot["lead"].to_numpy().astype(np.uint64), hot["df"].to_numpy().astype(np.uint64), percent, orders))

    posted = texts.mapInPandas(_postings(cuts, shared, width, big_token), "slice long, salt long, places binary, sids binary, ns binary, spots binary")
    met = cut(posted.groupBy("slice", "salt").applyInPandas(_candidates(cuts, percent, small_group, deals), "deal long, a binary, b binary, grp long, ns binary, es binary"))
    pairs = cut(met.where("grp is null").groupBy("deal").applyInPandas(_distinct_pairs, "a long, b long"))
    links = _link(base, reps, pairs, shared, width, percent)
    component = connected_components(links, "a", "b")

    groups = met.where("grp is not null").mapInPandas(_exploded, "grp long, sid long, n long, e long")
    groups = groups.groupBy("grp", "sid").agg(F.max("n").alias("n"), F.max("e").alias("e"))
    labelled = cut(groups.join(component.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    open_groups = labelled.groupBy("grp").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).where("x <> y")
    open_groups = cut(open_groups.select(F.col("grp").alias("__grp"), F.ceil(F.col("rows") / cell_rows).alias("cells")))
    inside = lookup(labelled, open_groups, "grp = __grp", how="inner").drop("__grp")
    cells = inside.withColumn("cell", F.pmod(F.xxhash64("sid"), F.col("cells"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    cells = cells.withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other"))
    where = ["grp", "low", "high"]
    more = cells.repartition(*where).sortWithinPartitions(*where).mapInPandas(_between(percent, deals), "deal long, a binary, b binary")
    late = cut(more.groupBy("deal").applyInPandas(_distinct_pairs, "a long, b long").join(pairs, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        links = links.union(_link(base, reps, late, shared, width, percent))
        component = connected_components(links, "a", "b")

    # A set of one row that links with nothing needs no look-up: its row is its component.
    in_one = reps.join(component.withColumnRenamed("node", "sid"), "sid", "left").where("component is not null or rows > 1")
    named = cut(in_one.select(F.col("sid").alias("__sid"), F.coalesce("component", "sid").alias("component")))
    return lookup(described, named, "sid = __sid").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row, from the components of ``jaccard_rows``, which takes ``options``.

    ``component_id`` is the least id of the component. Texts that are null or without words are their
    own component; rows without an id have none and are in no other row's. Repeated rows are rows.
    Extra columns are left out, an empty table gives no rows.
    """
    rows = cut(jaccard_rows(docs, **options))
    least = cut(rows.where("component is not null").groupBy(F.col("component").alias("__c")).agg(F.min("doc_id").alias("least")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return lookup(rows, least, "component = __c").select("doc_id", "n_shingles", own.alias("component_id"))


def _link(base: DataFrame, reps: DataFrame, pairs: DataFrame, orders, width: int, percent: int) -> DataFrame:
    """The pairs that hold: first by the prefixes under the other orders, which are short, then by whole sets."""
    close = cut(_with_sets(base, reps, pairs, _wanted(width, orders, True)).mapInPandas(_share_prefixes, "a long, b long"))
    return cut(_with_sets(base, reps, close, _wanted(width, orders, False)).mapInPandas(_similar(percent), "a long, b long"))


def _with_sets(base: DataFrame, reps: DataFrame, pairs: DataFrame, wanted, at_once: int = 300_000) -> DataFrame:
    """``a, b, x, y``: pairs with what ``wanted`` makes of the texts of both.

    The texts of the sets in question are looked up by the least id with that set, through a
    broadcast where they are ``at_once`` at most and through a shuffle otherwise.
    """
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    asked = cut(reps.join(sids, "sid").select(F.col("rep").alias("of"), "sid"))
    ids = asked.select("of").distinct()
    ids = F.broadcast(ids) if ids.count() <= at_once else ids
    texts = base.where("text is not null").join(ids, F.expr("doc_id <=> of"), "left_semi").select("text")
    sets = texts.mapInPandas(wanted, "sid long, sets array<binary>").dropDuplicates(["sid"]).join(asked.select("sid"), "sid", "left_semi")
    left = sets.select(F.col("sid").alias("a"), F.col("sets").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("sets").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
