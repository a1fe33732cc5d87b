"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import langid, lengths, licenses, mixing, neardup, ngram_join, packing, quality, queries, sharding, topk
from lantern.llm.text import Words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, n long, score double, bucket int"


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [sentence(rng, rng.randrange(5, 60)) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:  # near copies: one word changed
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", "   \n", "one", "one", "two words", "A\tB\x0bC d E f", sentence(rng, 6000), "é " * 8, "123 !!"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", None]), 1, 7, "x", 3, 0.5, 2))
    out.append(out[0])  # a repeated row
    out.append((None, base[3], None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_words_and_shingles(rows):
    texts = [r[1] for r in rows]
    found = Words(texts)
    runs, first = found.shingles(5)
    names, seen = {}, {}
    for i, t in enumerate(texts):
        own = words_of(t)
        assert found.first[i + 1] - found.first[i] == len(own)
        for w, h in zip(own, found.hashes[found.first[i] : found.first[i + 1]], strict=True):
            assert names.setdefault(w, h) == h
        assert len(set(runs[first[i] : first[i + 1]].tolist())) == len(shingles(t))
        if shingles(t):
            seen.setdefault(frozenset(shingles(t)), set()).add(frozenset(runs[first[i] : first[i + 1]].tolist()))
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)


def test_words_built_to_collide_do_not():
    """A Thue-Morse word and its complement, equal under powers of any odd multiplier modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    found = Words([word, word.translate(str.maketrans("ab", "ba")), word[:-1] + "c", word])
    assert len(set(found.hashes.tolist())) == 3 and found.hashes[0] == found.hashes[3]


def test_ngram_join(docs, rows, empty):
    found = ngram_join.jaccard_components(docs, small_group=3, cell_rows=4).collect()
    assert len(found) == len(rows)
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) >= 5
    want = components(list(sets), links)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == want[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_of_a_large_group(spark):
    """Copies with single changes around one text, and unlike texts that share a long passage with it."""
    rng = random.Random(2)
    base, passage = sentence(rng, 80).split(), sentence(rng, 30)
    texts = []
    for i in range(60):
        w = list(base)
        w[i % 80] = f"w{i}"
        texts.append(" ".join(w))
    texts += [passage + " " + sentence(rng, 25) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    for options in ({}, {"small_group": 2, "cell_rows": 7, "hot_from": 1000, "big_token": 5}, {"small_group": 2, "hot_from": 2, "big_token": 10}):
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, **options).collect()} == want


def vectors(spark, n=260, dim=16, labels=3):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):  # near copies of the first half
        x[i] = x[i - n // 2] + rng.normal(size=dim) * 0.08
    rows = [(i, [float(v) for v in np.float32(x[i])], i % (n // 2) % labels) for i in range(n)]
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 0), (n + 2, [0.0] * dim, 0), (n + 3, [float("nan")] + [1.0] * (dim - 1), 0), (n + 4, [None] + [1.0] * (dim - 1), 0), (n + 5, rows[1][1], None), (n + 6, [], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicates(spark):
    rows, df = vectors(spark)
    good = {i: (np.array(v, dtype=float), k) for i, v, k in rows if usable(v) and k is not None and any(v)}
    links = []
    for a in good:
        for b in good:
            if a < b and good[a][1] == good[b][1]:
                x, y = good[a][0], good[b][0]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((a, b))
    found = {r["vec_id"]: r for r in neardup.near_duplicates(df, cell_rows=9).collect()}
    count = Counter(x for p in links for x in p)
    assert len(found) == len(rows) and len(links) > 100
    met = sum(r["n_links"] for r in found.values())
    assert 0.98 * 2 * len(links) <= met <= 2 * len(links)
    assert all(r["n_links"] <= count[i] for i, r in found.items())
    want = components([r[0] for r in rows], links)
    same = sum(found[i]["component_id"] == want[i] for i in want)
    assert same >= 0.97 * len(want) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


@pytest.mark.parametrize("shared", [0.0, 0.6, 0.8])
def test_near_duplicates_of_rows_that_share_a_mean(spark, shared):
    """Planted pairs of cosine 0.94 among 4,000 rows whose cosine is ``shared`` otherwise."""
    rng = np.random.default_rng(5)
    dim, n = 48, 2000
    flat = rng.normal(size=(n, dim))
    flat[:, 0] = 0
    x = np.sqrt(1 - shared) * flat / np.linalg.norm(flat, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(shared)
    way = rng.normal(size=(n, dim))
    way -= (way * x).sum(axis=1, keepdims=True) * x
    y = 0.94 * x + math.sqrt(1 - 0.94**2) * way / np.linalg.norm(way, axis=1, keepdims=True)
    every = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.93).sum()) - len(unit)
    met = sum(r["n_links"] for r in neardup.near_duplicates(df).collect())
    print(f"shared {shared}: {met} of {links} links")
    assert links >= 2 * n and 0.98 * links <= met <= links


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("at_once", [8192, 3])
def test_top_k(spark, at_once):
    rows, df = vectors(spark, 150)
    v = topk.integer_vectors(df)
    found = topk.top_k(v, v.where("vec_id % 20 = 0"), k=4, queries_at_once=at_once).collect()
    ints = {i: np.floor(256 * np.array(x, dtype=float)).astype(int) for i, x, _ in rows if usable(x)}
    want = {}
    for q in ints:
        if q % 20 == 0:
            scores = []
            for i in ints:
                if i != q:
                    n = min(len(ints[i]), len(ints[q]))
                    scores.append((-int(ints[q][:n] @ ints[i][:n]), i))
            want[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:4])]
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert dict(got) == want


def test_top_k_with_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1]), (50, [2]), (7, [-3])], "vec_id long, ints array<long>")
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()} == {(0, 1, 50, 2), (0, 2, 7, -3), (50, 1, 0, 2), (50, 2, 7, -6)}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Equal rows count once; of a query id with two vectors the lesser asks, and both are candidates for others."""
    df = spark.createDataFrame([(0, [1, 1]), (0, [1, 1]), (1, [2, 0]), (1, [0, 5]), (2, [1, 0])], "vec_id long, ints array<long>")
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id < 2"), k=3).collect()}
    assert found == {(0, 1, 1, 5), (0, 2, 1, 2), (0, 3, 2, 1), (1, 1, 0, 5), (1, 2, 2, 0)}


def test_shards(docs, rows, empty):
    found = sharding.assign_shards(docs, sharding.topology(8)).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    slots = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(len(x) == 1 for x in by_id.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found)
    assert sizes == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    sums = Counter((r["doc_id"], r["text_crc32"]) for r in found)
    assert sums == Counter((r[0], None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    assert sharding.assign_shards(empty, sharding.topology(8)).count() == 0


def test_shards_follow_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    leaves = [sharding.Leaf("r0", "a", 0, 1), sharding.Leaf("r0", "b", 1, 3), sharding.Leaf("r1", "c", 2, 4)]
    more = [*leaves[:2], sharding.Leaf("r1", "c", 2, 6)]
    moved = keys.select(sharding.place(F.col("k"), leaves).alias("x"), sharding.place(F.col("k"), more).alias("y"), sharding.place(F.col("k"), sharding.grow(leaves)).alias("z")).collect()
    share = Counter(r["x"] for r in moved)
    assert abs(share[1] / 20_000 - 3 / 8) < 0.02 and abs(share[2] / 20_000 - 0.5) < 0.02
    assert all(r["y"] in (r["x"], 2) and r["z"] in (r["x"], 3) for r in moved)


def test_mix(spark, docs, rows, empty):
    found = mixing.mix_counts(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted((x for x in total if x is not None)) + [None] * (None in total)
    targets = dict(zip(names, mixing.water_fill([total[x] for x in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3.0), strict=True))
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert math.floor(r["rate"]) <= r["n_copies"] <= math.ceil(r["rate"]) <= 3
    again = mixing.mix_counts(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["size"], r["n_copies"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["n_copies"] for r in found)
    assert mixing.mix_counts(empty).count() == 0


def test_targets_of_many_sources(spark):
    """Targets of sources as uneven as hosts are, blank and null ones among them, are those of the plain fill."""
    rng = random.Random(4)
    sizes = {f"host-{i:03d}": int(rng.paretovariate(0.7) * 50) if i % 9 else 0 for i in range(240)} | {None: 700}
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, mixing.water_fill([sizes[x] for x in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3.0), strict=True))
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    found = mixing.rates(table, (1, 2, 3), 3.0).collect()
    assert len(found) == len(sizes) and all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in found)
    assert all(r["rate"] == pytest.approx(want[r["source"]] / r["source_size"] if r["source_size"] else 0) for r in found)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 200), f"s{min(i % 40, 3)}") for i in range(3000)]
    found = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("t"), F.first("target").alias("x")).collect()
    assert all(abs(r["t"] - r["x"]) <= 0.02 * r["x"] for r in found)


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 1], 3) == [100, 100]
    assert mixing.water_fill([10, 990], [1, 1], 3) == [30, 970]
    assert mixing.water_fill([0, 5], [1, 2], 3) == [0, 5]


def test_packing(docs, rows, empty):
    found = packing.pack(docs, max_length=500, buckets=3, budget=1000).collect()
    pieces = defaultdict(int)
    cells = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]] += r["length"]
        assert r["length"] <= r["padded_length"] and r["start"] == r["piece"] * 500
        cells[(r["bucket"], r["batch"], r["padded_length"])].append(r["slot"])
    want = Counter()
    for r in rows:
        want[r[0]] += len(WORDS.findall(r[1] or ""))
    assert pieces == dict(want)
    for (bucket, batch, padded), slots in cells.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * padded <= max(1000, padded)
        if (bucket, batch + 1, padded) in cells:
            assert len(slots) == max(1, 1000 // padded)
    assert packing.pack(empty).count() == 0


def test_packing_query_counts_tokens(spark, small):
    encode = lengths._encoding(open(lengths.VOCABULARY, "rb").read()).encode_ordinary
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    size = {r["doc_id"]: len(encode(r["text"] or "")) for r in docs}
    found, batches = Counter(), Counter()
    for r in queries.op9_bucket_packing(spark, small).collect():
        assert r["length"] <= r["padded_length"] <= 2048
        found[r["doc_id"]] += r["length"]
        batches[r["bucket"], r["batch"]] += r["padded_length"]
    assert found == size and max(batches.values()) <= 16_384


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted(rng.sample(range(50), rng.randrange(1, 9)))
        counts, k = [rng.randrange(1, 9) for _ in sizes], rng.randrange(1, 5)
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= s) for s, c in zip(sizes, counts, strict=True))  # noqa: B023, E731
        best = min(cost([*x, sizes[-1]]) for r in range(k) for x in itertools.combinations(sizes[:-1], r))
        assert cost(packing.optimal_boundaries(sizes, counts, k)) == best


def test_lengths(docs, rows, empty):
    import tiktoken

    encoding = lengths._encoding(open(lengths.VOCABULARY, "rb").read())
    assert isinstance(encoding, tiktoken.Encoding)
    own = sorted(len(encoding.encode_ordinary(r[1] or "")) for r in rows)
    sums = lengths.suffix_sums(lengths.length_histogram(docs), block=16).cache()
    for r in sums.collect():
        assert r["n_docs"] == own.count(r["length"]) and r["docs_over"] == sum(x > r["length"] for x in own)
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in own) and r["total_tokens"] == sum(own)
    limits = [0, 3, 17, 100, 10**6]
    assert {r["context"]: r["truncated_tokens"] for r in lengths.at_limits(sums, limits).collect()} == {c: sum(min(x, c) for x in own) for c in limits}
    assert {r["share"]: r["length"] for r in lengths.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: own[math.ceil(len(own) * 0.5) - 1], 1.0: own[-1]}
    assert lengths.suffix_sums(lengths.length_histogram(empty)).count() == 0


def test_licenses(spark, empty):
    rng = random.Random(6)
    texts, want = [], set()
    for i, (name, notice) in enumerate(licenses.NOTICES.items()):
        texts.append(f"{sentence(rng, 90)}\n{notice.upper()}\n{sentence(rng, 40)}")
        want.add((i, name))
        texts[-1] = texts[-1]
    texts += [None, "", "licensed", sentence(rng, 500), "redistribution and use in source and binary forms, with or without modification, are permitted provided that"]
    texts += [sentence(rng, 20_000) + " Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, license int")
    found = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(docs).collect()}
    own = {n: shingle_set(t) for n, t in licenses.NOTICES.items()}
    brute = {(i, n) for i, t in enumerate(texts) for n in own if len(own[n] & shingle_set(t or "")) >= 0.75 * len(own[n])}
    assert want <= brute and set(found) == brute
    assert licenses.scan_licenses(empty).count() == 0


def test_license_bands_retrieve(spark):
    """Of each notice three quarters of its shingles, amid other words: how often the bands retrieve it, over batches of a task."""
    rng = random.Random(12)
    every = licenses.license_templates()
    names = [n for n in every if len(words_of(every[n])) >= 12]
    rows = []
    for name in names:
        own = every[name].split()
        for _ in range(12):
            keep = math.ceil(0.8 * len(own)) + 1
            at = rng.randrange(len(own) - keep + 1)
            rows.append((len(rows), f"{sentence(rng, rng.randrange(80))} {' '.join(own[at : at + keep])} {sentence(rng, 20)}", name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").coalesce(1)
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, every).collect()}
    sets = {n: shingle_set(every[n]) for n in names}
    held = [(i, n) for i, t, n in rows if len(sets[n] & shingle_set(t)) >= 0.75 * len(sets[n])]
    met = sum(x in found for x in held)
    print(f"bands retrieve {met} of {len(held)}")
    assert len(held) >= 400 and met >= 0.999 * len(held)


def test_license_query_covers_bodies_variants_and_spdx(spark, tmp_path):
    rng = random.Random(7)
    every = licenses.license_templates()
    bodies = [n for n in every if n.endswith("-text")]
    # Bodies without their opening words, each amid other text.
    texts = [f"{sentence(rng, 70)}\n{' '.join(every[n].split()[15:])}\n{sentence(rng, 30)}" for n in bodies]
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    texts += [lesser, lesser.replace("Lesser", "Affero"), lesser.replace("Lesser ", ""), "This project is licensed under the MIT License."]
    texts += ["// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nint x;", "Licensed under CC BY-SA 4.0.", sentence(rng, 300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = defaultdict(set)
    for r in queries.op10_license_scan(spark, str(tmp_path)).collect():
        found[r["doc_id"]].add(r["license"])
    for i, name in enumerate(bodies):
        assert {x for x in found[i] if x.endswith("-text")} == {name}
    at = len(bodies)
    grants = [{x for x in found[at + i] if x.endswith("-grant")} for i in range(3)]
    assert grants == [{"LGPL-grant"}, {"AGPL-grant"}, {"GPL-grant"}]
    assert found[at + 3] == {"MIT-licensed"} and found[at + 4] == {"SPDX:MIT", "SPDX:Apache-2.0", "SPDX:GPL-2.0-only"}
    assert found[at + 5] == {"CC-BY-SA-4.0-short"} and not found[at + 6]


def shingle_set(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_languages(spark, small, docs, empty):
    table = spark.read.parquet(f"{small}/documents.parquet")
    found = langid.identify_languages(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert len(out) > 20 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.9 * len(out)
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    ids = {r["text"]: r["doc_id"] for r in docs.select("doc_id", "text").collect()}
    assert all(odd[ids[t]]["lang_pred"] == "und" for t in (None, "", "   \n", "123 !!")) and odd[ids["one"]]["lang_pred"] != "und"
    assert langid.identify_languages(empty).count() == 0


def test_net_forward_and_gradient():
    """The filters against loops over windows, and one step of training against differences of the loss."""
    rng = np.random.default_rng(1)
    texts, labels = ["aab bba ab ab", "xyx yyx xxy y", "ab ba", "yx xy"], ["p", "q", "p", "q"]
    net = langid.train_net(texts, labels, filters=3, size=2, window=16, epochs=2, seed=3)
    codes = langid.windows(texts[0], net.window, net.width)
    want = np.zeros((len(codes), 2))
    for i, own in enumerate(codes):
        peaks = []
        for f in range(net.kernel.shape[1]):
            sums = [sum(float(net.embed[own[t + k]] @ net.kernel[k * 2 : k * 2 + 2, f]) for k in range(net.width)) for t in range(net.window)]
            peaks.append(max(0.0, max(sums) + float(net.bias[f])))
        want[i] = np.array(peaks) @ net.dense + net.offset
    assert np.allclose(net.logits(codes.T), want, atol=1e-4)

    params = {"embed": net.embed, "kernel": net.kernel, "bias": net.bias, "dense": net.dense, "offset": net.offset}
    x, y = np.concatenate([langid.windows(t, 16, net.width) for t in texts]).T, np.array([0, 1, 0, 1])
    mask = (net.kernel != 0).astype(np.float32)

    def loss(p):
        out = langid.ByteNet(net.languages, window=16, **p).logits(x)
        return float(-np.log(langid.softmax(out.astype(float))[np.arange(4), y]).mean())

    grad = langid.gradients(net, x, y, mask)
    for name, g in grad.items():
        spots = np.argwhere(np.abs(g) > 1e-3)
        for at in rng.permutation(spots)[:6]:
            shifted = []
            for step in (1e-2, -1e-2):
                p = {k: v.astype(float).copy() for k, v in params.items()}
                p[name][tuple(at)] += step
                shifted.append(loss(p))
            assert (shifted[0] - shifted[1]) / 2e-2 == pytest.approx(g[tuple(at)], rel=0.1, abs=2e-3)


def test_quality_is_learnt_and_posteriors_are_those_of_a_plain_version(spark):
    """Fitted on two thirds of the labels and asked on the rest; posteriors against loops over documents."""
    folder = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_quality(table, labels.where("doc_id % 3 <> 0"))
    found = quality.score_quality(table, model, F.col("source"), F.col("lang")).select("row.doc_id", "row.source", "row.lang", "text_p", "host_p", "path_p", "quality_p", "quality_keep").collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 3 = 0").collect()}
    out = [r for r in found if r["doc_id"] in truth]
    assert len(out) > 50 and sum(r["quality_keep"] == bool(truth[r["doc_id"]]) for r in out) >= 0.95 * len(out)
    known = [r for r in found if r["text_p"] is not None]
    sites, hosts = defaultdict(list), defaultdict(list)
    for r in known:
        sites[r["source"], r["lang"]].append(r["text_p"])
        hosts[r["source"]].append(r["text_p"])
    mean = sum(r["text_p"] for r in known) / len(known)

    def worth(groups):
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values()) / len(known)
        spread = max(between - len(groups) * max(mean * (1 - mean), 1e-9) / len(known), 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)

    logit = lambda p: math.log(p / (1 - p))
    a, b = worth(hosts), worth(sites)
    for r in known:
        h, q = hosts[r["source"]], sites[r["source"], r["lang"]]
        host = (sum(h) - r["text_p"] + a * mean) / (len(h) - 1 + a)
        path = (sum(q) - r["text_p"] + b * host) / (len(q) - 1 + b)
        assert r["host_p"] == pytest.approx(host) and r["path_p"] == pytest.approx(path)
        assert r["quality_p"] == pytest.approx(1 / (1 + math.exp(-logit(r["text_p"]) - logit(path) + logit(mean))))


def test_quality(spark, small, docs, empty):
    table, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit_quality(table, labels)
    found = quality.score_quality(table, model, F.col("source"), F.col("lang")).select("row.doc_id", "quality_keep").join(labels, "doc_id").collect()
    assert sum(r["quality_keep"] == bool(r["quality"]) for r in found) >= 0.95 * len(found)
    odd = quality.score_quality(docs, model, F.col("source"), F.col("lang")).select("row.*", "text_p", "quality_p", "quality_keep").collect()
    assert len(odd) == docs.count() and all(r["text_p"] is None and not r["quality_keep"] for r in odd if not WORDS.findall(r["text"] or ""))
    assert quality.score_quality(empty, model, F.col("source"), F.col("lang")).count() == 0
    assert quality.fit_quality(empty, labels).base == 0.5


def test_sparse_sites_shrink(spark):
    """A site with one document follows the prior; a large one its own evidence, wherever its documents lie."""
    good, bad = "the quiet words of a calm text go on and on here", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"
    rows = [(i, good, "x", "p") for i in range(200)] + [(1000 + i, bad, "y", "p") for i in range(200)] + [(3000, good, "z", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[1] == good)) for r in rows[:400:3]], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    found = {r["source"]: r for r in quality.score_quality(docs, model, F.col("source"), F.col("lang")).select("row.source", "host_p", "path_p").dropDuplicates(["source"]).collect()}
    assert found["x"]["host_p"] > 0.8 > found["z"]["host_p"] > 0.2 > found["y"]["host_p"]


def test_tokens_of_long_blank_runs(spark):
    encoding = lengths._encoding(open(lengths.VOCABULARY, "rb").read())
    rng = random.Random(8)
    for _ in range(300):
        parts = [rng.choice(["a", "Wort", "x1", "'s", "!?", " ", "\n", "\x1c", "\u3000"]) + rng.choice([" ", "\n", " \n", "\t\xa0", "\u2003"]) * rng.choice([0, 1, 999, 1000, 1001, 2500]) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        assert lengths.count_tokens(encoding, text) == len(encoding.encode_ordinary(text)), repr(text)
    half = {blank: lengths.count_tokens(encoding, f"a{blank * 200_000}b") for blank in " \n"}
    assert half == {blank: len(encoding.encode_ordinary(f"a{blank * 200_000}b")) for blank in " \n"}
    docs = spark.createDataFrame([(0, " " * 3_000_000), (1, "\n" * 3_000_000), (2, "a" + " " * 3_000_001 + "b"), (3, "x")], "doc_id long, text string")
    found = {r["length"]: r["n_docs"] for r in lengths.length_histogram(docs).collect()}
    # One token a blank and one for two line breaks, as in shorter runs.
    assert found == Counter({3_000_000: 1, 1_500_000: 1, 3_000_002: 1, 1: 1})
    assert packing.pack(docs, length=lengths.token_counter(docs)(F.col("text"))).agg(F.sum("length")).first()[0] == 3_000_000 + 1_500_000 + 3_000_002 + 1
