"""Exact ranked lexical search by presence-mask grouping.

Terms are runs of word characters, A-Z lower-cased. One job turns each document into its term count n and the (term, tf) pairs of terms that
items ask for; a second one gives N, L and document frequencies; the third scores. There a batch of documents holds, for each item, a
bitmap of presence per term. Packed together they give every document a mask of matched terms; documents of equal mask form a
group, whose score is at most the sum over its terms of the impact of the batch's greatest tf in the group's shortest document. Groups are
evaluated by descending bound, and an item is finished with a batch once the next bound is under its k-th best score. Each task keeps the k
best of every item, and a window by item merges the tasks.

Items come to the tasks in blocks of at most `BLOCK_BYTES` of terms, each with its own pass over the documents, so what is sent doesn't grow with
the item table. An item of many terms takes its documents in smaller batches (`CELLS`), so tasks hold bounded matrices.

Scores are 64-bit integers as in `top_documents`; bounds are doubles rounded up by more than their error.

Defined cases: a null or empty text has no terms, and such a document counts nowhere; every row is a document of its own, also a repeated one; items of equal id and
text are one item, others of one id are ranked each for itself; an item without terms or matches has no rows; a null doc_id comes last among equal scores;
empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import cut

K = 20
BLOCK_BYTES = 32 << 20
CELLS = 1 << 20
#: Characters of a text that are split at once.
PART = 1 << 20
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
CAPITALS = re.compile("[A-Z]+")


def counted(text: str | None) -> Counter:
    """How often each term occurs; long texts in parts that end between terms."""
    found: Counter = Counter()
    at = 0
    while text and at < len(text):
        end = GAP.search(text, at + PART)
        stop = end.start() if end else len(text)
        part = text[at:stop]
        part = part.lower() if part.isascii() else CAPITALS.sub(lambda m: m[0].lower(), part)
        found.update(TERM.findall(part))
        at = stop
    return found


class Block:
    """Some items: their ids, and for each the numbers of its terms and how often it names them."""

    def __init__(self, first: int):
        self.first, self.ids, self.items, self.vocabulary, self.bytes = first, [], [], {}, 0

    def add(self, item_id: str | None, terms: Counter) -> None:
        for t in terms:
            if t not in self.vocabulary:
                self.vocabulary[t] = len(self.vocabulary)
                self.bytes += len(t) + 100
        self.ids.append(item_id)
        self.items.append((np.array([self.vocabulary[t] for t in terms], dtype=np.int64), np.array(list(terms.values()), dtype=np.int64)))
        self.bytes += 16 * len(terms) + 100


def blocks_of(items: DataFrame, limit: int) -> Iterator[Block]:
    block = Block(0)
    for row in items.toLocalIterator():
        terms = counted(row["text"])
        if terms:
            block.add(row["item_id"], terms)
        if block.bytes > limit:
            yield block
            block = Block(block.first + len(block.ids))
    if block.ids:
        yield block


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n and the vocabulary's terms of every document that has terms."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in batches:
            n, starts, terms, tfs = [], [0], [], []
            for text in b.column(1):
                found = counted(text.as_py())
                n.append(sum(found.values()))
                for t in found.keys() & number.keys() if len(found) < len(number) else (t for t in number if t in found):
                    terms.append(number[t])
                    tfs.append(found[t])
                starts.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Ranking:
    """The k best documents of an item so far: by score, then id, a null id last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, null, -score))[: self.k]
        order = order[score[order] > 0]
        self.score, self.null, self.id = score[order], null[order], ids[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


def grouped(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (columns) by their mask of present terms (rows): order, where each group starts in it, and the groups' bits (groups x terms)."""
    bits = np.packbits(present, axis=0, bitorder="little")
    width = -(-len(bits) // 8) * 8
    masks = np.zeros((bits.shape[1], width), dtype=np.uint8)
    masks[:, : len(bits)] = bits.T
    words = masks.view(np.uint64)
    order = np.lexsort(words.T[::-1]) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
    sorted_ = words[order]
    starts = np.concatenate([[0], np.nonzero((sorted_[1:] != sorted_[:-1]).any(axis=1))[0] + 1])
    return order, starts, np.unpackbits(masks[order[starts]], axis=1, bitorder="little")[:, : len(present)]


def rank_batch(ranking: Ranking, tf: np.ndarray, value: np.ndarray, m: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
    """Rank documents (columns) with these term frequencies (rows); `value` is weight times repeats of each term."""
    order, starts, bits = grouped(tf > 0)
    shortest = np.minimum.reduceat(m[order], starts).astype(float)
    most = tf.max(axis=1).astype(float)
    bound = np.zeros(len(starts))
    for t in range(len(value)):
        bound += bits[:, t] * (value[t] * (1e9 * most[t] / (1000 * most[t] + 12 * shortest)))
    bound = bound * (1 + 1e-9) + 1
    ends = np.append(starts[1:], len(order))
    by_bound = np.argsort(-bound, kind="stable")
    sizes = np.cumsum((ends - starts)[by_bound])
    at, take = 0, 4 * ranking.k
    while at < len(by_bound) and bound[by_bound[at]] >= ranking.floor:
        done = sizes[at - 1] if at else 0
        stop = int(np.searchsorted(sizes, done + take)) + 1
        some = by_bound[at:stop]
        some = some[bound[some] >= ranking.floor]
        docs = np.concatenate([order[starts[g] : ends[g]] for g in some])
        for s in range(0, len(docs), size := max(1, CELLS // len(value))):
            part = docs[s : s + size]
            ranking.add((value[:, None] * impact(tf[:, part], m[part])).sum(axis=0), null[part], ids[part])
        at, take = stop, 2 * take


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of greatest score above 0 for each item.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and the score sums
    weight * ((10**9 tf) div (1000 tf + 12 m)) over the item's terms with repeats.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    found = None
    for block in blocks_of(items.select(F.col("item_id").cast("string"), "text").distinct(), block_bytes):
        rows = scored(spark, docs, block, k)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "item_id string, place long, doc_id long, score long")
    w = Window.partitionBy("item_id", "place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("item_id").cast(kind), "rank", "doc_id", "score")


def scored(spark, docs: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best documents of each item of a block in each partition of the documents."""
    posted = cut(postings(docs, spark.sparkContext.broadcast(block.vocabulary)))
    total = posted.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = total["N"], max(total["L"], 1)
    df = np.zeros(len(block.vocabulary), dtype=np.int64)
    for t, c in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[t] = c
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    sent, first = spark.sparkContext.broadcast((block.ids, block.items, weight)), block.first

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, weights = sent.value
        rankings = [Ranking(k) for _ in ids]
        for b in batches:
            m = 75 + (25 * b.column(1).to_numpy() * n_docs) // n_terms
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_id = b.column(0).fill_null(0).to_numpy()
            owner = np.repeat(np.arange(len(m)), b.column(2).value_lengths().to_numpy())
            term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            order = np.argsort(term, kind="stable")
            term, tf, owner = term[order], tf[order].astype(np.int64), owner[order]
            edges = np.searchsorted(term, np.arange(len(weights) + 1))
            for (terms, times), ranking in zip(items, rankings):
                value = times * weights[terms]
                step = max(64, CELLS // len(terms))
                for lo in range(0, len(m), step):
                    dense = np.zeros((len(terms), min(step, len(m) - lo)), dtype=np.int64)
                    for row, t in enumerate(terms):
                        a, z = edges[t], edges[t + 1]
                        if step < len(m):
                            a, z = a + np.searchsorted(owner[a:z], [lo, lo + step])
                        dense[row, owner[a:z] - lo] = tf[a:z]
                    some = np.nonzero(dense.any(axis=0))[0]
                    if len(some):
                        rank_batch(ranking, dense[:, some], value, m[lo + some], null[lo + some], doc_id[lo + some])
        for place, (item_id, r) in enumerate(zip(ids, rankings)):
            if len(r.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item_id] * len(r.score), pa.string()), pa.array([first + place] * len(r.score), pa.int64()),
                    pa.array(r.id, pa.int64(), mask=r.null), pa.array(r.score, pa.int64()),
                ], names=["item_id", "place", "doc_id", "score"])

    return posted.mapInArrow(score, "item_id string, place long, doc_id long, score long")
