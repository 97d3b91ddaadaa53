"""Substring dedup by content-defined chunking with a gear rolling hash.

Each byte shifts the hash left by one and adds its number from a fixed table, so the low 16 bits depend on the last 16 bytes alone. A
chunk ends where the low bits are zero, between a least and a greatest size; the ends follow the content, and an insertion moves
only the chunks around it. Chunks that occur in more than one document, found by digest, are repeats. A run of consecutive repeated
chunks of at least `MIN_RUN` characters is a repeated passage; it stays where it occurs first (smallest doc_id, then position) and
is removed elsewhere.

The hash of a whole text is built from four shifted sums; only the choice of ends is a loop, over the few candidates.

Defined cases: a null text stays null and an empty one empty, both without chunks; repeated rows of one id count as one document, and
so do all rows without an id, which come last. Within one document nothing is a repeat. Digests have 64 bits and are not compared
further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LEAST, GREATEST, MASK_BITS = 24, 256, 5
#: Characters that a run of repeated chunks must cover. Passages of over 50 words cover far more.
MIN_RUN = 120
#: Stands for a null id; such rows count as one document, the last.
NO_ID = (1 << 63) - 1
RUN = "struct<start:int,stop:int,drop:array<struct<start:int,stop:int>>>"
RUNS = f"array<{RUN}>"
GEAR = np.random.RandomState(7).randint(0, 1 << 16, 256).astype(np.uint16)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes, at character borders."""
    n = len(data)
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for by in (1, 2, 4, 8):
        later = h[by:] + (h[:-by] << np.uint16(by))  # the sum of the last `by` bytes joins that of the `by` bytes before
        h = np.concatenate((h[:by], later))
    zero = (h & np.uint16(((1 << MASK_BITS) - 1) << (16 - MASK_BITS))) == 0
    zero[:-1] &= (b[1:] & 0xC0) != 0x80
    out, last = [], 0
    for e in [*(np.nonzero(zero)[0] + 1).tolist(), n]:
        while e - last > GREATEST:
            last += GREATEST
            while last < n and (data[last] & 0xC0) == 0x80:
                last += 1
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, key, digest (64 bits), seq, start, size: chunks of every text in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, digests, starts, sizes = [], [], [], []
            for text in b["text"]:
                data = text.encode("utf-8", "replace")
                ends = cut_points(data)
                digests += [hashlib.blake2b(data[p:q], digest_size=8).digest() for p, q in zip([0, *ends], ends)]
                at = np.array([0, *ends])
                if len(data) != len(text):
                    at = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))[at]
                counts.append(len(ends))
                starts.append(at[:-1])
                sizes.append(np.diff(at))
            if counts:
                yield pd.DataFrame({
                    "doc_id": np.repeat(b["doc_id"].to_numpy(), counts), "key": np.repeat(b["key"].to_numpy(), counts),
                    "digest": np.frombuffer(b"".join(digests), np.int64), "seq": np.concatenate([np.arange(n) for n in counts]),
                    "start": np.concatenate(starts), "size": np.concatenate(sizes),
                })

    rows = docs.where("text <> ''").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInPandas(run, "doc_id long, key long, digest long, seq int, start int, size int")


def repeats(pieces: DataFrame) -> DataFrame:
    """digest, first: chunks that more than one document has, with the place (doc_id, seq) of the first one."""
    seen = pieces.groupBy("digest").agg(F.min(F.struct("doc_id", "seq")).alias("first"), F.max("doc_id").alias("last"))
    return seen.where("first.doc_id < last").select("digest", "first")


def runs_of(found: Column, least: int = MIN_RUN) -> Column:
    """Runs (start, stop, drop) of consecutive repeated chunks; drop: their parts that occur earlier elsewhere, as (start, stop)."""
    kind = RUN
    zero = F.struct(F.array().cast(RUNS).alias("done"), F.lit(None).cast(kind).alias("open"))

    def closed(s: Column) -> Column:
        keep = s["open"].isNotNull() & (s["open"]["stop"] - s["open"]["start"] >= least)
        return F.when(keep, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, c: Column) -> Column:
        stop = c["start"] + c["size"]
        part = F.when(c["own"], F.array().cast("array<struct<start:int,stop:int>>")).otherwise(F.array(F.struct(c["start"].alias("start"), stop.alias("stop"))))
        joins = F.coalesce(s["open"]["stop"] == c["start"], F.lit(False))
        longer = F.struct(s["open"]["start"].alias("start"), stop.alias("stop"), F.concat(s["open"]["drop"], part).alias("drop"))
        fresh = F.struct(c["start"].alias("start"), stop.alias("stop"), part.alias("drop"))
        return F.when(joins, F.struct(s["done"].alias("done"), longer.cast(kind).alias("open"))).otherwise(
            F.struct(closed(s).alias("done"), fresh.cast(kind).alias("open"))
        )

    return F.aggregate(found, zero, step, closed)


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the `drop` parts of its runs."""
    parts = F.flatten(F.transform(runs, lambda r: r["drop"]))

    def cut_out(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(p, lambda x: x["stop"]))
        stops = F.concat(F.transform(p, lambda x: x["start"]), F.array(F.char_length(text)))
        return F.array_join(F.zip_with(starts, stops, lambda a, b: F.substr(text, a + 1, b - a)), "")

    return F.when(F.size(runs) > 0, let(parts, cut_out)).otherwise(text)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text without passages that stand earlier elsewhere, n_chars, n_repeated and n_removed (code
    points), and spans, the repeated passages as start:stop."""
    docs = docs.select("doc_id", "text")
    pieces = chunks(docs)
    met = pieces.join(repeats(pieces), "digest").select(
        "doc_id", "key", F.struct("start", "size", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("seq") == F.col("first.seq"))).alias("own")).alias("c")
    )
    found = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("c")).alias("found")).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), runs_of(F.col("found")).alias("runs")
    ).where("size(runs) > 0")
    d = docs.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_text"))
    x = d.join(found, (d["_doc"] == found["_id"]) & (d["_text"] == found["_key"]), "left")
    runs = F.coalesce("runs", F.array().cast(RUNS))
    length = F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    x = x.select("doc_id", "text", runs.alias("runs"), length.alias("n_repeated"))
    spans = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["stop"])), ",")
    out = x.select("doc_id", kept_text(F.col("text"), F.col("runs")).alias("kept"), F.char_length("text").cast("long").alias("was"), "n_repeated", spans.alias("spans"))
    n = F.char_length("kept").cast("long")
    return out.select("doc_id", F.col("kept").alias("text"), F.coalesce(n, F.lit(0)).alias("n_chars"), "n_repeated", F.coalesce(F.col("was") - n, F.lit(0)).alias("n_removed"), "spans")
