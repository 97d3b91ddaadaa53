"""MinHash near-duplicates by chosen paths.

Documents with the same shingle set form a class, and only classes are compared. In every tree a class goes to the node that its tokens at
a few minwise positions chosen by the tree name. The more classes there are, the more tokens a path takes and the more trees there are, so that
only sets with much in common crowd a node. Nodes of at most `LEAF` classes compare all their members by sketch; larger ones compare
every member with a few centres, half of them with the most common tokens (by the sizes of a class's nodes) and half drawn by the
node. Trees share few positions, so a pair at the threshold meets in none of them with a probability of about 0.15 ** 10, and is below the bar of
small nodes with no more; a lower threshold gets more trees and a lower bar for candidates. Candidates are confirmed on full shingle sets: first the strongest
spanning links, then all candidates that would still join different components. Components come from label propagation.

Large nodes lose nothing: all their classes also meet by prefixes of their full sets, rarest shingles first. Two sets of the similarity asked for
share a shingle of their prefixes, whatever the sketches say, so every such pair of large nodes is found unless the links already join it.

Groups that hold a large share of the rows stay cheap: copies collapse into a class with a map-side combine, large nodes form
members x centres pairs, and the prefixes only pairs of different components. Node joins are salted, and only bounded nodes are collected.

Defined cases: a null or empty text, or one without words, has no shingles and is its own component; fewer words than a shingle make
one shingle; repeated rows share a class; ids may repeat or be null (a null id is never a component's id unless all are null).
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.skew import IN_TASK, cut
from .common import forget, packed, shuffles_freed, text_key, unpacked

SHINGLE, THRESHOLD = 3, 85
SKETCH = 64
LEAF, CENTRES, SALTS = 16, 4, 32
#: Chance that a pair at the threshold meets in no tree.
MISSED = 0.15**10
#: Most tokens of a path, which are enough for 10**8 classes.
MOST_DEPTH = 6

#: Characters of text whose words are hashed together.
IN_BLOCK = 4_000_000

#: Buckets of shingle hashes that are counted to put rare shingles first.
ORDER = 1 << 20

#: Buckets whose parities tell sets apart.
PARITIES = 512

#: Shingles before one in a prefix that tell whether it is the first that two sets share.
BEFORE = 4

#: Stands for a null id in joins.
NO_ID = -(1 << 63)

_rng = np.random.RandomState(20240607)
MULTIPLY = (_rng.randint(0, 2**62, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.randint(0, 2**62, SKETCH, dtype=np.uint64)
ROLL = (_rng.randint(0, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, from the words' hashes."""
    n = max(0, len(h) - size + 1)
    x = np.full(n, size, np.uint64)
    for k in range(size):
        x += h[k : n + k] * ROLL[k]
    return mixed(x)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: Iterable[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text. Bytes are lower-cased and split, which touches ASCII alone."""

    def made(block: list[list[bytes]]) -> Iterator[np.ndarray]:
        words = [w for ws in block for w in ws]
        h = hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64)
        x, at = shingles(h, size), 0
        for ws in block:
            n = len(ws)
            yield distinct(x[at : at + n - size + 1] if n >= size else shingles(h[at : at + n], max(n, 1)))
            at += n

    block, chars = [], 0
    for t in texts:
        block.append((t or "").encode("utf-8", "surrogatepass").lower().split())
        chars += len(t or "")
        if chars > IN_BLOCK:
            yield from made(block)
            block, chars = [], 0
    yield from made(block)


def sketch_of(x: np.ndarray) -> np.ndarray:
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (x[None, i : i + 4096] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return (low >> np.uint64(48)).astype(np.uint16).view(np.int16)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, key (text identity), class (digest of the shingle set; null if empty) and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], size))
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_shingles": [len(s) for s in sets],
                "key": b["key"], "class": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "sketch": [sketch_of(s) if len(s) else None for s in sets],
            })

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    return keyed.mapInPandas(run, "doc_id long, n_shingles long, key string, class binary, sketch array<smallint>")


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """A checkpoint, and how many of its rows meet the condition, in one job."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return done, seen.get["n"]


def places(depth: int, trees: int) -> list[list[int]]:
    """The positions that make up a path of each tree. Trees share none of them as long as there are enough."""
    rng, out = np.random.RandomState(depth), []
    while len(out) < trees:
        out += rng.permutation(SKETCH)[: SKETCH // depth * depth].reshape(-1, depth).tolist()
    return out[:trees]


def shared(rows: DataFrame) -> DataFrame:
    """The rows of nodes with company, with the node's size `n`."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    copies = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["node", "salt"]).drop("salt")


PAIR = "a binary, b binary, agree int, first boolean"


def least_agreement(threshold: int) -> int:
    """Agreements of two sketches below which a pair is not confirmed: 4 standard deviations under what the threshold (in percent) gives."""
    t = threshold / 100
    return max(1, math.floor(SKETCH * t - 4 * math.sqrt(SKETCH * t * (1 - t))))


def sure_agreement(threshold: int) -> int:
    """Agreements of two sketches that a pair at the threshold lacks with a chance of at most `MISSED`."""
    t, chance = threshold / 100, 0.0
    for agree in range(SKETCH):
        chance += math.comb(SKETCH, agree) * t**agree * (1 - t) ** (SKETCH - agree)
        if chance > MISSED:
            return max(1, agree)
    return SKETCH


def trees_for(threshold: int, depth: int = 1) -> int:
    """Trees that miss a pair at the threshold with a chance of at most `MISSED`, if a node takes `depth` tokens."""
    return 1 if threshold >= 100 else math.ceil(math.log(MISSED) / math.log(1 - (threshold / 100) ** depth) - 1e-9)


def depth_for(rows: int) -> int:
    """Tokens that name a node of so many rows: with them, sets that share a twentieth of their shingles fill no node on average."""
    return max(1, min(MOST_DEPTH, round(math.log(max(rows, 1) / LEAF, 20))))


def compare(nodes: DataFrame, agree_least: int) -> DataFrame:
    """All pairs of each small node whose sketches agree enough; `first` marks a strongest spanning forest of the node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["members"]:
                ids = [bytes(m["class"]) for m in members]
                m = np.array([x["sketch"] for x in members], np.int16)
                agree = (m[:, None, :] == m[None, :, :]).sum(axis=2)
                i, j = np.nonzero(np.triu(agree >= agree_least, 1))
                group = list(range(len(ids)))
                for k in np.argsort(-agree[i, j], kind="stable"):
                    p, q = group[i[k]], group[j[k]]
                    if p != q:
                        group = [p if g == q else g for g in group]
                    a, b = sorted((ids[i[k]], ids[j[k]]))
                    out.append((a, b, int(agree[i[k], j[k]]), p != q))
            yield pd.DataFrame(out, columns=["a", "b", "agree", "first"])

    grouped = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("class", "sketch"))).alias("members"))
    return grouped.select("members").mapInPandas(run, PAIR)


def agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def star(rows: DataFrame) -> DataFrame:
    """Members of large nodes with their agreement with a few centres: one of each part that the node's hash makes, in half of the parts the
    member with the most common tokens and in the others any."""
    part = F.pmod(F.xxhash64("class", "node"), F.lit(CENTRES))
    order = F.when(part < CENTRES // 2, F.col("common")).otherwise(F.xxhash64("node", "class"))
    top = rows.groupBy("node", part.alias("part")).agg(F.max(F.struct(order.alias("order"), "class", "sketch")).alias("c"))
    centres = top.groupBy("node").agg(F.collect_list(F.struct("c.class", "c.sketch")).alias("centres"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    others = F.filter("centres", lambda c: c["class"] != F.col("class"))
    near = F.transform(others, lambda c: F.struct(agreement(F.col("sketch"), c["sketch"]).alias("agree"), c["class"].alias("centre")))
    return salted.join(centres.select("node", "centres", salts), ["node", "salt"]).select("node", "class", "sketch", "common", near.alias("near"))


def star_pairs(starred: DataFrame, agree_least: int) -> DataFrame:
    """Pairs of members and centres; `first` marks each member's best one."""
    # at most trees * levels * centres of them meet a class
    met = starred.select("class", F.explode(F.filter("near", lambda c: c["agree"] >= agree_least)).alias("m")).groupBy("class").agg(F.collect_set("m").alias("met"))
    ranked = met.select("class", F.posexplode(F.sort_array("met", asc=False)).alias("rank", "m"))
    pair = (F.least("class", "m.centre").alias("a"), F.greatest("class", "m.centre").alias("b"))
    return ranked.select(*pair, "m.agree", (F.col("rank") == 0).alias("first"))


def candidates(classes: DataFrame, threshold: int = THRESHOLD, depth: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs of classes (a < b) that some node puts together, with `first` for those to confirm first; and the classes of large nodes, if there are any."""
    paths = places(depth, trees_for(threshold, depth))
    nodes = F.array(*[F.xxhash64(F.lit(f"tree{r}"), *[F.get("sketch", F.lit(p)) for p in path]) for r, path in enumerate(paths)])
    rows = classes.select("class", F.explode(nodes).alias("node"))
    # at most one node of each tree meets a class
    own = shared(rows).groupBy("class").agg(F.sum("n").alias("common"), F.collect_list(F.struct("node", "n")).alias("nodes"))
    met = own.join(classes.select("class", "sketch"), "class").select("class", "sketch", "common", F.inline("nodes"))
    met, crowded = cut_and_count(met.select("node", "class", "sketch", "common", "n"), F.col("n") > LEAF)
    many = met.where(F.col("n") > LEAF)
    found, large = [cut(compare(met.where(F.col("n") <= LEAF), sure_agreement(threshold)))], None
    if crowded:
        found.append(cut(star_pairs(star(many), least_agreement(threshold))))
        large = cut(many.select("class").distinct())
    forget(met)
    return functools.reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("first").alias("first")), large


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of `ORDER` buckets of hashes: a table of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(ORDER, np.int64)
        for b in batches:
            for x in b["set"]:
                np.add.at(seen, bucket_of(np.frombuffer(x, np.uint64)), 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    counts = np.zeros(ORDER, np.int64)
    found = sets.select("set").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def bucket_of(x: np.ndarray) -> np.ndarray:
    return (x % np.uint64(ORDER)).astype(np.int64)


def parities(x: np.ndarray) -> np.ndarray:
    """Whether each of `PARITIES` buckets holds an odd number of a set's shingles, as bits. Two sets differ in no more of them than in shingles."""
    odd = np.bincount((x >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_pairs(sets: DataFrame, group: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: pairs of sets in different groups that share a shingle of their prefixes, among them every pair of the similarity asked for.

    A prefix holds as many shingles as a set can lack in a similar one, and one more. Any order common to all sets gives every such pair; shingles
    of rare buckets come first, as they meet few others. Pairs go that have too few shingles left from a common one on, or too many odd ones apart:
    bounds that no pair of the similarity asked for breaks at its first common shingle. Most rows of a pair's further common shingles go, too.
    """
    counts = sets.sparkSession.sparkContext.broadcast(token_counts(sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, tokens, odd = [], [], []
            for s in b["set"]:
                x = np.frombuffer(s, np.uint64)
                n = len(x)
                order = np.lexsort((x, counts.value[bucket_of(x)]))
                sizes.append(n)
                tokens.append(x[order[: n - (n * threshold + 99) // 100 + 1]].view(np.int64))
                odd.append(parities(x))
            yield pd.DataFrame({"class": b["class"], "n": sizes, "tokens": tokens, "odd": odd})

    prefix = sets.select("class", "set").mapInPandas(run, "class binary, n long, tokens array<long>, odd array<long>").join(group, "class", "left")
    prefix = cut(prefix.select("class", "n", F.coalesce("label", "class").alias("label"), "tokens", "odd"))
    before = lambda at: F.slice("tokens", F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE)))
    at_each = F.transform("tokens", lambda token, at: F.struct(token.alias("token"), (F.col("n") - at).alias("left"), before(at).alias("before")))
    prefix = prefix.select("class", "n", "label", "odd", F.inline(at_each))
    mixed = prefix.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    open_ = prefix.join(mixed, "token")
    side = ("class", "n", "label", "odd", "left", "before")
    x, y = open_.select("token", F.struct(*side).alias("x")), open_.select("token", F.struct(*side).alias("y"))
    # what is left from the first common shingle on has to be enough, which also bounds the sizes
    enough = (100 + threshold) * F.least("x.left", "y.left") >= threshold * (F.col("x.n") + F.col("y.n"))
    apart = functools.reduce(Column.__add__, [F.bit_count(F.get("x.odd", F.lit(i)).bitwiseXOR(F.get("y.odd", F.lit(i)))) for i in range(PARITIES // 64)])
    close = (100 + threshold) * apart <= (100 - threshold) * (F.col("x.n") + F.col("y.n"))
    first = ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("x.class") < F.col("y.class")) & (F.col("x.label") != F.col("y.label")) & enough & close & first)
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs whose full sets have the similarity asked for, in percent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield b.loc[keep, ["a", "b"]]

    sa, sb = sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))
    return pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary")


def full_sets(docs: DataFrame, classes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """class, set: the full shingle set of each class, from the text of its representative row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], size))
            yield pd.DataFrame({"class": [hashlib.md5(s.tobytes()).digest() for s in sets], "set": [s.tobytes() for s in sets]})

    wanted = classes.select(F.col("rep").alias("doc_id"), F.col("class").alias("wanted"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text")
    return texts.mapInPandas(run, "class binary, set binary")


def joined(links: DataFrame) -> DataFrame:
    """`components` of few links, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                low, high = sorted((top(up.setdefault(bytes(a), bytes(a))), top(up.setdefault(bytes(b), bytes(b)))))
                up[high] = low
        yield pd.DataFrame({"class": list(up), "label": [top(x) for x in up]})

    return cut(links.coalesce(1).mapInPandas(run, "class binary, label binary"))


def components(links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """class, label: the smallest class reachable. Labels spread along links and jump to their label's label; up to `in_task` links are joined at once."""
    links, n = cut_and_count(links.select("a", "b"), F.lit(True))
    if n <= in_task:
        return joined(links)
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both.distinct())
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("class"), F.least("u", "v").alias("label"))
    while True:
        heard = both.join(labels.select(F.col("class").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        spread = labels.join(heard, labels["class"] == heard["u"]).select("class", "label", F.least("label", "heard").alias("near"))
        up = labels.select(F.col("class").alias("near"), F.col("label").alias("far"))
        moved = spread.join(up, "near").select("class", F.col("label").alias("old"), F.least("near", "far").alias("label"))
        moved, changes = cut_and_count(moved, F.col("old") != F.col("label"))
        if not changes:
            return moved.select("class", "label")
        labels = moved.select("class", "label")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, key, class, component_id, kept."""
    docs = docs.select("doc_id", "text")
    with shuffles_freed(docs.sparkSession):
        made, rows = cut_and_count(sketches(docs, size), F.col("class").isNotNull())
        classes = cut(made.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
        pairs, large = candidates(classes, threshold, depth_for(rows))
        pairs = cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class"))
        wanted = wanted if large is None else wanted.unionByName(large)
        sets = cut(full_sets(docs, wanted.distinct().join(classes.select("class", "rep"), "class"), size))
        group = components(confirmed(pairs.where("first"), sets, threshold))
        ga, gb = group.select(F.col("class").alias("a"), F.col("label").alias("la")), group.select(F.col("class").alias("b"), F.col("label").alias("lb"))
        open_ = pairs.where("NOT first").select("a", "b")
        if large is not None:
            open_ = open_.unionByName(prefix_pairs(sets.join(large, "class", "left_semi"), group, threshold)).distinct()
        open_ = open_.join(ga, "a", "left").join(gb, "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")
        # groups are the nodes of the last round
        links = confirmed(open_, sets, threshold).join(ga, "a", "left").join(gb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        top = components(links.distinct()).select(F.col("class").alias("label"), F.col("label").alias("top"))
        known = group.unionByName(top.select("label", "label").toDF("class", "label")).dropDuplicates(["class", "label"])
        label = cut(known.join(top, "label", "left").select("class", F.coalesce("top", "label").alias("label")))
    reps = classes.select("class", "rep").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    low = reps.where(F.col("label") != F.col("class")).groupBy("label").agg(F.min("rep").alias("low")).select(F.col("label").alias("l"), "low")
    target = reps.join(low, reps["label"] == low["l"], "left").select("class", "label", "rep", "low")
    # `low` leaves out the label's own class, whose rep joins here
    own = reps.select(F.col("class").alias("label"), F.col("rep").alias("own"))
    final = target.join(own, "label").select("class", F.least("own", "low").alias("component"))
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = made.select("doc_id", "n_shingles", "key", "class").join(final, "class", "left").select("doc_id", "n_shingles", "key", "class", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with all its columns; of repeated rows, one stays."""
    used = ("doc_id", "text")
    rows = near_duplicates(docs, size, threshold).withColumn("g", F.coalesce(F.hex("class"), "key"))
    # without a component's id there is nothing to choose by but the class itself
    group = F.when(F.col("component_id").isNull(), F.col("g"))
    keep = rows.where("component_id IS NULL OR doc_id = component_id").groupBy("component_id", group.alias("g")).agg(F.min(F.struct("doc_id", "key")).alias("r"))
    keep = keep.select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    # plain keys, so that the join leaves equal rows together and no further shuffle is needed
    none = F.lit(NO_ID)
    met = packed(docs, *used).withColumns({"_id": F.coalesce("doc_id", none), "_key": text_key(F.col("text"))}).join(
        keep.select(F.coalesce("_id", none).alias("_id"), "_key"), ["_id", "_key"]
    )
    return unpacked(met.dropDuplicates(["_id", "_key"]), docs.columns, used)
