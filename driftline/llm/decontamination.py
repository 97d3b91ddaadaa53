"""Benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

An item window occurs in a document only if its rarest word does, so one word per window, the rarest in the corpus, is a
sufficient prefix for exact containment. Document positions of prefix words give candidate starts; position and length
bounds drop impossible ones, and the window is compared with the document's words.

Defined cases: a null or empty text has no words; an item without words has no window; repeated rows each get their result;
null ids are kept as rows of their own (null item ids are not reported). Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, split_words, text_key, unpacked

WINDOW = 13
#: Bytes of window text that one broadcast may hold; larger benchmarks are joined in blocks of items.
BLOCK_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))))


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win: every run of `size` words of an item, or the whole of a shorter one."""
    n = F.size("words")
    runs = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.slice("words", i, size))).when(n > 0, F.array("words"))
    return items.select("item_id", words_of(F.col("text")).alias("words")).select("item_id", F.explode(runs).alias("win")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """word, off, n, win, wid: each distinct window under its rarest word by count over all documents."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = (
        docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    )
    unique = windows.select("win").distinct().select("win", F.md5(F.array_join("win", " ")).alias("wid"))
    ranked = (
        unique.select("wid", F.posexplode("win").alias("off", "word")).join(counts, "word", "left")
        .groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off")).alias("rarest"))
    )
    # a window with a word that no document has cannot occur
    return unique.join(ranked.where("rarest.df > 0"), "wid").select("rarest.word", "rarest.off", F.size("win").alias("n"), "win", "wid")


def occurrences(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """doc_id, key, start, n, wid for every window at every place where it occurs."""
    placed = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words")).select(
        "doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "word")
    )
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("n") <= F.size("words"))
    # the slice start is clamped: conditions may be evaluated in any order
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win")
    return placed.join(F.broadcast(prefix), "word").where(fits & same).select("doc_id", "key", start.alias("start"), "n", "wid")


def covered(runs: Column) -> Column:
    """Number of positions inside any of the runs (start, n), sorted by start."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))

    def step(s: Column, r: Column) -> Column:
        end = r["start"] + r["n"]
        return F.struct(
            (s["total"] + F.greatest(F.lit(0), end - F.greatest(s["upto"], r["start"]))).alias("total"), F.greatest(s["upto"], end).alias("upto")
        )

    return F.aggregate(runs, zero, step)["total"]


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and key (text identity)."""
    docs = docs.select("doc_id", "text")
    windows = windows_of(items.select("item_id", "text"), size)
    measured = windows.agg(F.sum(F.aggregate("win", F.lit(16).cast("long"), lambda s, w: s + F.octet_length(w)))).first()[0] or 0
    blocks = max(1, math.ceil(measured / block_bytes))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        one = occurrences(docs, prefixes(part, docs))
        found = one if found is None else found.unionByName(one)
    per_doc = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"), F.collect_set("wid").alias("wids"))
    item_of = windows.where("item_id IS NOT NULL").select(F.md5(F.array_join("win", " ")).alias("wid"), F.col("item_id").cast("string").alias("item"))
    hit = (
        per_doc.select("doc_id", "key", covered(F.col("runs")).alias("n_hit"), F.explode("wids").alias("wid"))
        .join(item_of, "wid", "left")
        .groupBy("doc_id", "key").agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    d = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(split_words(F.coalesce("text", F.lit("")))).alias("n_words")).alias("d")
    h = hit.alias("h")
    item_ids = F.coalesce("h.item_ids", F.array().cast("array<string>"))
    n_words, n_hit = F.coalesce("d.n_words", F.lit(0)).cast("long"), F.coalesce("h.n_hit", F.lit(0)).cast("long")
    return d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key")), "left").select(
        "d.doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(item_ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"), "d.key",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
    used = ("doc_id", "text")
    return unpacked(packed(docs, *used).join(bad, same, "left_anti"), docs.columns, used)
