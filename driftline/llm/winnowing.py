"""Document fingerprints by winnowing (DataFrame functions only).

A text is lower-cased and cut into words (runs longer than 32 characters into pieces of 32). Hashes of k = 5 consecutive
words are built by rolling pairs together; every window of w = 8 hashes keeps its minimum, the rightmost on ties, with its
position. Any run of w + k - 1 words that two texts share puts a common entry into both fingerprints.

An entry packs the hash (37 bits) above the complement of the position (26 bits), so the plain minimum prefers the smaller hash
and then the larger position. Likeness of two fingerprints is the Jaccard similarity of their hash sets.

Defined cases: a null or empty text, or one without words, has an empty fingerprint; two empty ones have likeness 1, an empty and
a non-empty one 0; fewer than k words make one gram; fewer than w grams make one window. Rows of one id are ordered by text.
A null id has no place in the order: its next document is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, split_words

K, W = 5, 8
PIECE = 32
POSITION_BITS = 26
POSITION_MASK = (1 << POSITION_BITS) - 1
HASH_MASK = (1 << 37) - 1
#: Documents per span of ids; a span and one row of the next one meet in a task.
SPAN_ROWS = 2000
CELLS = 64


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def head(a: Column, drop: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - drop, F.lit(0)))


def paired(a: Column, b: Column, by: int, f) -> Column:
    """f(a[i], b[i + by]) for every i where both exist."""
    return F.zip_with(head(a, by), shifted(b, by), f)


def pieces(text: Column) -> Column:
    """Words; the rare long ones are cut into pieces."""
    cut = lambda w: F.split(F.rtrim(F.regexp_replace(w, f"(.{{{PIECE}}})", "$1 ")), " ")
    long = lambda w: F.char_length(w) > PIECE
    return let(
        split_words(text), lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, lambda w: F.when(long(w), cut(w)).otherwise(F.array(w))))).otherwise(ws)
    )


def grams(words: Column) -> Column:
    mix = lambda x, y: F.xxhash64(x, y)
    one = F.transform(words, lambda w: F.xxhash64(w))

    def five(h1: Column) -> Column:
        return let(paired(h1, h1, 1, mix), lambda h2: let(paired(h2, h2, 2, mix), lambda h4: F.zip_with(head(h4, 1), shifted(h1, 4), mix)))

    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= K, let(one, five)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column) -> Column:
    """Array of packed entries in window order; equal texts have equal arrays."""
    words = pieces(F.lower(F.coalesce(text, F.lit(""))))
    least = lambda x, y: F.least(x, y)
    packed = F.transform(
        let(words, grams), lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS).bitwiseOR(F.lit(POSITION_MASK) - i)
    )

    def minima(p: Column) -> Column:
        rolled = let(paired(p, p, 1, least), lambda m2: let(paired(m2, m2, 2, least), lambda m4: paired(m4, m4, 4, least)))
        return F.when(F.size(p) >= W, F.array_distinct(rolled)).when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(p)

    return let(packed, minima)


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda e: F.shiftright(e, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_span(docs: DataFrame, rows: int = SPAN_ROWS) -> DataFrame:
    """The rows with `_span`, a number that rises with doc_id and covers about `rows` rows however the ids are spread.

    Ids are cut into 64 cells of about equal count, each cell into spans of equal width.
    """
    cuts = [i / CELLS for i in range(CELLS + 1)]
    s = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", cuts, 10000).alias("q")).first()
    if not s["n"]:
        return docs.withColumn("_span", F.lit(0).cast("long"))
    edges = sorted(set(s["q"]))
    per_cell = max(1, round(s["n"] / CELLS / rows))
    lows = F.lit(",".join(str(x) for x in edges))
    arr = F.split(lows, ",").cast("array<bigint>")
    cell = F.size(F.filter(arr, lambda x: x <= F.col("doc_id")))
    low, high = F.get(arr, F.greatest(cell - 1, F.lit(0))), F.get(arr, cell)
    width = F.greatest(F.ceil((F.coalesce(high, low + 1) - low) / per_cell), F.lit(1))
    inner = F.least(F.greatest(F.floor((F.col("doc_id") - low) / width), F.lit(0)), F.lit(per_cell))
    return docs.withColumn("_span", (cell * (per_cell + 1) + inner).cast("long"))


def previous_span(spans: DataFrame) -> DataFrame:
    """span, before: the span in front of each one, and the last in front of the first; in two levels of 4096."""
    coarse = spans.withColumn("c", F.floor(F.col("span") / 4096))
    edges = coarse.groupBy("c").agg(F.max("span").alias("last"))
    top = edges.agg(F.max("last").alias("top"), F.lit(1).alias("one"))
    chain = edges.withColumn("link", F.lag("last").over(Window.orderBy("c"))).select("c", "link", F.lit(1).alias("one"))
    chain = chain.join(F.broadcast(top), "one").select("c", F.coalesce("link", "top").alias("link"))
    inside = coarse.withColumn("before", F.lag("span").over(Window.partitionBy("c").orderBy("span")))
    return inside.join(chain, "c").select("span", F.coalesce("before", "link").alias("before"))


def with_next(docs: DataFrame, rows: int = SPAN_ROWS) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp by ascending doc_id, the first after the last; one shuffle of the texts."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = with_span(d.where("doc_id IS NOT NULL"), rows)
    rank = F.struct("doc_id", F.xxhash64("text"), "text")
    first_ids = placed.groupBy("_span").agg(F.min("doc_id").alias("doc_id"))
    before = previous_span(first_ids.select(F.col("_span").alias("span")))
    heads = first_ids.join(before, first_ids["_span"] == before["span"]).select("_span", "doc_id", "before")
    # a head also visits the span in front of it, as the row after that span's last
    guests = (
        placed.join(heads, ["_span", "doc_id"]).groupBy("_span", "before").agg(F.min(rank).alias("r"))
        .select(F.col("before").alias("_span"), "r.doc_id", "r.text", F.lit(True).alias("guest"))
    )
    both = placed.select("_span", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests).repartition("_span")
    # last in its span, also where ids start anew
    w = Window.partitionBy("_span").orderBy("guest", "doc_id", "hash")
    found = both.withColumn("fp", fingerprint(F.col("text"))).withColumn("hash", F.xxhash64("text"))
    found = found.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("NOT guest")
    alone = d.where("doc_id IS NULL").withColumn("fp", fingerprint(F.col("text"))).withColumn("next_text", F.lit("")).withColumn(
        "next_fp", F.array().cast("array<bigint>")
    )
    names = ["doc_id", "text", "fp", "next_text", "next_fp"]
    return found.select(names).unionByName(alone.select(names))


def fingerprints(docs: DataFrame, rows: int = SPAN_ROWS) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and likenesses."""
    n = F.char_length("text")
    m = F.floor(n / 2).cast("int")
    x = with_next(docs, rows).select(
        "doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp",
        F.concat(F.substr("text", F.lit(1), n - m), F.substr("next_text", F.lit(1), m)).alias("edited"),
    )
    x = x.select("doc_id", "n_chars", "fp", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("next_fp")).alias("next_h"), fingerprint(F.col("edited")).alias("efp"))
    h = let(hashes(F.col("fp")), lambda a: F.struct(
        likeness(a, hashes(F.col("efp"))).alias("near_edited"), likeness(a, F.col("next_h")).alias("near_next")
    ))
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return x.withColumn("near", h).select(
        "doc_id", "n_chars", "edited_sha256", line("fp").alias("fingerprint"), line("efp").alias("edited_fingerprint"), "near.near_edited", "near.near_next"
    )
