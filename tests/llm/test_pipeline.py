"""The pipeline on the smallest tables, stage by stage against plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import lengths

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    first = {r["doc_id"] for r in kept["quality"]}
    assert sum(d in first for d, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(d in first for d, q in labels.items() if q == 0) <= 0.1 * max(1, sum(q == 0 for q in labels.values()))
    assert len(kept["language"]) >= 0.97 * len(first)

    def shingles(text):
        w = WORDS.findall(text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [(r["doc_id"], shingles(r["text"])) for r in kept["near_duplicates"]]
    assert not [1 for i, (_, a) in enumerate(sets) for _, b in sets[:i] if 100 * len(a & b) >= 75 * len(a | b)]
    assert {r["doc_id"] for r in kept["near_duplicates"]} <= {r["doc_id"] for r in kept["language"]}
    copies = Counter(r["doc_id"] for r in kept["mixture"])
    assert set(copies) <= {d for d, _ in sets} and max(copies.values()) <= 3
    encode = lengths._encoding(open(lengths.VOCABULARY, "rb").read()).encode_ordinary
    size = {r["doc_id"]: len(encode(r["text"])) for r in kept["near_duplicates"]}
    packed = Counter()
    for r in kept["packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == {d: n * size[d] for d, n in copies.items()}


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_odd_rows(spark, small):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, "a b c d e f", None, None, None), (3, None, "en", None, None), (4, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()) == ["1", "3", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
        stage(spark, docs, small).collect()


def test_rows_of_one_id_with_unlike_texts_stay(spark, small):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(1, texts["a"]), (5, texts["a"]), (5, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (8, texts["d"].upper()), (9, None), (9, None), (9, ""), (None, texts["e"]), (None, texts["e"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()]
    want = [(1, texts["a"]), (5, texts["b"]), (7, texts["c"]), (7, texts["d"]), (9, None), (9, ""), (None, texts["e"]), (None, texts["e"])]
    assert Counter(found) == Counter(want)


def test_columns_of_any_name(spark, small):
    """Columns that stages might use themselves come out with their own values."""
    names = ["__id", "__key", "__found", "found", "row", "id", "key", "count", "copy", "n", "component", "stays", "__c", "text_key", "n_copies", "size", "rate", "target", "__t", "quality_keep", "piece", "length", "bucket"]
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in names])
    docs = docs.union(docs.where("doc_id < 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names), name
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, small).collect()} == {r["doc_id"] for r in docs.collect()}
