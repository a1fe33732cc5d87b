"""Spelling variants: words one edit apart, found through a variable-length gram index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.runtime import cut

#: Fixed: letters of words, lower case from translate(); one of so many runs loses a code point.
LETTERS = "[a-zÀ-ÿ]+"
LOSES = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks around a word, so that its first and last letters are in as many grams as others.
BEGIN, END = "\x02", "\x03"
#: Least code points of a word; lengths of grams. A word of n letters has n + 1 grams, at most LONGEST of them over one
#: letter, so of a word of 5 two grams at least outlive any edit.
LEAST_WORD, SHORTEST, LONGEST = 5, 2, 4


def word_counts(docs: DataFrame, shortest: int = LEAST_WORD, least: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the letter runs of whole texts: those of ``shortest`` code points that occur ``least`` times.

    Runs are lower-cased in A-Z only. Where 97 divides the checksum of the row's id and the run, the run
    loses a code point. Counts are summed before the shuffle, so a frequent word is no hot key. A null
    id counts as an empty one; null texts have no words; repeated rows count as rows.
    """
    ids = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(ids.alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    check = F.crc32(F.concat("id", F.lit(":"), F.col("run")))
    at = F.pmod(check, F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(check % LOSES == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _grams(word: Column, length: int) -> Column:
    """All grams of one length of a marked word."""
    marked = F.concat(F.lit(BEGIN), word, F.lit(END))
    places = F.when(F.length(marked) >= length, F.sequence(F.lit(1), F.length(marked) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(marked, i, F.lit(length)))


def gram_dictionary(words: DataFrame, prefixes: int = 50_000, least: int = 32) -> dict[str, int]:
    """The frequent grams with their counts in ``words``; a gram that is one letter longer than one of them belongs to the dictionary too.

    A gram of ``SHORTEST`` letters is in the dictionary; a longer one, up to ``LONGEST``, if the gram
    without its last letter is frequent, that is in more than ``least`` places and in more than one in
    ``prefixes`` of all. So no length has more than ``prefixes`` frequent grams, which bounds what the
    driver gets and sends, whatever the number of words.
    """
    places = words.agg(F.sum(F.length("word") + 1).alias("n")).first()["n"] or 0
    grams = F.flatten(F.array(*(_grams(F.col("word"), k) for k in range(SHORTEST, LONGEST + 1))))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > max(least, places // prefixes)).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """``(gram, place)`` for each place of the marked word but the last: the longest gram of the dictionary that begins there."""
    marked = BEGIN + word + END
    out = []
    for at in range(len(marked) - 1):
        end = at + SHORTEST
        while end < len(marked) and end - at < LONGEST and marked[at:end] in frequent:
            end += 1
        out.append((marked[at:end], at))
    return out


def outliving(order: list[tuple[str, int]], before: int, behind: int, most: int = 2) -> tuple[tuple[int, bool], ...]:
    """The first grams of ``order`` that end by ``before`` or begin from ``behind`` on, by number, and whether they lie behind.

    Which gram begins at a place depends on no letter outside it, as a gram ends where it stops being
    frequent. So an edit changes only the grams over its letter or its gap, and these are not them.
    """
    found = []
    for i, (gram, at) in enumerate(order):
        if at >= behind or at + len(gram) <= before:
            found.append((i, at >= behind))
            if len(found) == most:
                break
    return tuple(found)


def keys(word: str, frequent: dict[str, int]) -> tuple[list[str], list[str]]:
    """The index lists that a word is on, and those in which it looks for others of its length or one letter less.

    For each edit the grams that it can't affect are known, and the same grams, in the same order of
    rarity, outlive it in the other word. Those before the edit keep their place from the start, those
    behind it their place from the end. So both words know the two rarest that outlive, and meet where
    their two lists do: a key is the two grams with their places and the shorter word's length. A word
    has one key for each kind of edit and pair of grams, far fewer than edits.
    """
    order = sorted(decompose(word, frequent), key=lambda g: (frequent.get(g[0], 0), g[0], g[1]))
    n = len(word)
    # A letter replaced or lost, and a letter put between two others.
    letters = {outliving(order, i, i + 1) for i in range(1, n + 1)}
    gaps = {outliving(order, i + 1, i + 1) for i in range(n + 1)}

    def apart(length: int, found: tuple[tuple[int, bool], ...]) -> str:
        return f"{length}|" + "".join(f">{n + 2 - order[i][1]}{order[i][0]}" if behind else f"<{order[i][1]}{order[i][0]}" for i, behind in found)

    same = list({f"{n}=" + "".join(f"{order[i][1]}{order[i][0]}" for i, _ in found) for found in letters})
    return same + [apart(n, x) for x in gaps], same + [apart(n - 1, x) for x in letters]


def near_words(words: DataFrame, prefixes: int = 50_000, least: int = 32) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of ``words`` (``word, n``, of 5 or more code points) that differ by one inserted, deleted or replaced code point, once.

    The frequency-pruned dictionary is built over all words; every word is decomposed, and for each edit
    put where the lists of the two rarest grams that outlive it merge. Lists are met by a join, whose
    heavy keys the adaptive plan splits, and every pair that meets is verified. No pair is lost, as
    ``keys`` shows.
    """
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(gram_dictionary(words, prefixes, least))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            both = [keys(w, frequent.value) for w in pdf["word"]]
            yield pdf.assign(on=[b[0] for b in both], looks=[b[1] for b in both])

    indexed = cut(words.select("word", "n").mapInPandas(index, "word string, n long, on array<string>, looks array<string>"))
    a = indexed.select(F.explode("on").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = indexed.select(F.explode("looks").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = a.join(b, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def follow(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``word, root`` for ``word, form`` without cycles: the last of each chain, by steps that double each round."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        up = roots.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = cut(roots.join(up, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"chains did not end in {rounds} rounds; forms have a cycle")


def group_variants(words: DataFrame, ratio: int = 2, prefixes: int = 50_000, least: int = 32) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each of ``words`` (``word, n``, distinct, of 5 or more code points).

    A word's form is its near word of the largest n, of several the first in code-point order, if that n
    is at least ``ratio`` times the word's; ``root`` is the last form of the chain, or the word itself.
    As n grows along a chain, it has no cycle. Null words are left out; an empty table gives no rows.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"))
    pairs = near_words(words, prefixes, least)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("near")), F.struct(F.col("b").alias("at"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form")).alias("near")))).alias("s"))
    best = sides.groupBy("s.at").agg(F.count("*").alias("n_near"), F.min("s.near").alias("best"))
    joined = words.join(best, F.col("word") == F.col("at"), "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    roots = follow(formed.where("form is not null")).withColumnRenamed("word", "of")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
