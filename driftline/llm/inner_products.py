"""Exact top-k inner products in norm order, with rotated partial sums and Cauchy-Schwarz bounds.

Components are quantised to integers. One job sums the outer products of all vectors; the eigenvectors of that matrix (the right singular
vectors of the whole table) are the rotation that moves most of a typical length into the first dimensions. Rows are range-partitioned
by descending length and packed into blocks of at most `BLOCK_BYTES`; query vectors are packed alike.

Seeds: the k-th best score of a query among the longest vectors (the first block) is a floor under its result. Then every block of queries meets every slab
(blocks s, s + slabs, ...) in one task that walks the slab by descending length. A query is done once |q||c| falls under its floor. For the
others the inner product is summed over a growing head of rotated dimensions; what is left is at most the product of the two residual
lengths, and pairs whose bound is under the floor go. Pairs left at the end are scored in integers, and floors rise with
what is found. A slab gives at most k rows a query; a window by query (which Spark limits to k rows before its shuffle) merges them.

Bounds hold with a slack of 1e-9 of the lengths for rounding, far above the error of sums in doubles, and only decide what is scored; every
returned score is an integer sum.

Copies: of a run of equal vectors, sorted by id, a query can need only the first k rows that don't have its own id. So a run keeps k rows of an
id at most, and only while fewer than k rows precede besides those of one id: at most 2 k in a partition, whatever its length. That loses nothing.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors of different lengths have
no product; rows that repeat the query's id are its own; equal rows are one query, and different vectors of one id are queries of their own under that id;
fewer candidates give fewer rows; an empty table gives none. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import cut

SCALE = 1024
K = 10
BLOCK_BYTES = 2 << 20
QUERY_BYTES = 8 << 20
#: Blocks that one task walks at most.
SLAB_BLOCKS = 256
#: Cells of one partial-sum matrix in a task.
CELLS = 1 << 21
HEADS = (0.125, 0.25, 0.5, 1.0)
SLACK = 1e-9
#: Longest vectors with a rotation: a matrix of 1024 x 1024 numbers is what the driver holds. Longer ones keep their axes.
ROTATED = 1024


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of integers), d, squared: the vectors that take part."""
    x = F.col(embedding)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    squared = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.select("vec_id", "v", F.size("v").alias("d"), squared.alias("squared"))


def rotation_of(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all rows of length d, strongest first; from sums of outer products, d x d numbers."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((d, d))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(float)
                s += m.T @ m
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": s[i, j]})

    cells = rows.where(F.col("d") == d).select("v").mapInPandas(outer, "i int, j int, s double")
    cell = cells.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((d, d))
    m[cell["i"], cell["j"]] = cell["s"]
    m[cell["j"], cell["i"]] = cell["s"]
    return np.linalg.eigh(m)[1][:, ::-1].copy()


def packed(rows: DataFrame, limit: int, copies: int | None) -> DataFrame:
    """Blocks in partition order: at, d, w (bytes a component), top (greatest length), ids and components as bytes.

    Of a run of equal vectors stay those that a search for `copies` rows can need.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vs: list[np.ndarray] = []
        top, last = 0.0, None
        before = own = most = 0  # rows kept of this run, of the id at hand, of the most frequent id

        def block() -> pd.DataFrame:
            m = np.stack(vs)
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
            frame = pd.DataFrame({
                "d": [m.shape[1]], "w": [np.dtype(kind).itemsize], "top": [top], "ids": [np.array(ids, dtype=np.int64).tobytes()], "data": [m.astype(kind).tobytes()],
            })
            ids.clear()
            vs.clear()
            return frame

        for b in batches:
            for i, v, squared in zip(b["vec_id"].to_numpy(), b["v"].to_numpy(), b["squared"].to_numpy()):
                if last is None or not np.array_equal(v, last[1]):
                    before = own = most = 0
                elif i != last[0]:
                    own = 0
                last = i, v
                if copies is not None and (own >= copies or before - most >= copies):
                    continue
                before, own = before + 1, own + 1
                most = max(most, own)
                if ids and (len(vs[0]) != len(v) or (len(ids) + 1) * v.nbytes > limit):
                    yield block()
                if not ids:
                    top = float(np.sqrt(squared))
                ids.append(int(i))
                vs.append(v)
        if ids:
            yield block()

    found = rows.select("vec_id", "v", "squared").mapInPandas(pack, "d int, w int, top double, ids binary, data binary")
    return found.withColumn("at", F.monotonically_increasing_id())


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.int64)


def matrix(data: bytes, d: int, w: int) -> np.ndarray:
    return np.frombuffer(data, dtype={2: np.int16, 4: np.int32, 8: np.int64}[w]).reshape(-1, d).astype(np.int64)


class Best:
    """The k best (score, id) of each query of a block so far, and the floor that a new score has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.copy()
        self.count = np.zeros(len(floors), dtype=np.int64)
        self.id, self.score = np.zeros((2, len(floors), k), dtype=np.int64)

    def rows(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        filled = np.arange(self.k) < self.count[q][:, None]
        return np.repeat(q, self.count[q]), self.id[q][filled], self.score[q][filled]

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        changed = np.unique(q)
        q, ids, score = (np.concatenate(x) for x in zip(self.rows(changed), (q, ids, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.id[q[kept], place[kept]], self.score[q[kept], place[kept]] = ids[kept], score[kept]
        self.count[changed] = np.minimum(np.searchsorted(q, changed, "right") - np.searchsorted(q, changed), self.k)
        full = changed[self.count[changed] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k - 1])


class Asked:
    """A block of queries in a task: integers, rotated numbers and lengths, computed once."""

    def __init__(self, ids: bytes, q: np.ndarray, rotation: np.ndarray | None):
        self.ids, self.q, self.rotation = numbers(ids), q, rotation
        self.turned = self.turn(q)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.turned, self.turned))

    def turn(self, m: np.ndarray) -> np.ndarray:
        return m.astype(float) if self.rotation is None else m.astype(float) @ self.rotation

    def reaches(self, floor: np.ndarray, length: float) -> np.ndarray:
        """Queries for which vectors of at most this length can reach the floor."""
        return self.length * length * (1 + SLACK) + SLACK >= floor


def rest(m: np.ndarray, done: int) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m[:, done:], m[:, done:]))


def meet(best: Best, asked: Asked, ids: np.ndarray, c: np.ndarray) -> None:
    """Score one block of candidates for one block of queries, as far as the bounds let them in."""
    d = c.shape[1]
    cr = asked.turn(c)
    lengths = rest(cr, 0)
    heads = sorted({max(1, round(d * h)) for h in HEADS})
    step = max(1, CELLS // len(c))
    todo = np.nonzero(asked.reaches(best.floor, lengths.max()))[0]
    for lo in range(0, len(todo), step):
        rows, cols = todo[lo : lo + step], np.arange(len(c))
        sums, done = np.zeros((len(rows), len(cols))), 0
        slack = SLACK * (1 + np.outer(asked.length[rows], lengths))
        for h in heads:
            sums += asked.turned[rows, done:h] @ cr[cols, done:h].T
            done = h
            alive = sums + np.outer(rest(asked.turned[rows], h), rest(cr[cols], h)) + slack >= best.floor[rows][:, None]
            r, k = alive.any(axis=1), alive.any(axis=0)
            rows, cols, sums, slack, alive = rows[r], cols[k], sums[np.ix_(r, k)], slack[np.ix_(r, k)], alive[np.ix_(r, k)]
            if not len(rows):
                break
        alive &= asked.ids[rows][:, None] != ids[cols][None, :]
        if len(rows) and len(cols) > best.k:  # the k-th best of this block, less the slack, is a floor too
            low = np.where(alive, sums - slack, -np.inf)
            alive &= sums + slack >= -np.partition(-low, best.k - 1, axis=1)[:, best.k - 1 : best.k]
        i, j = np.nonzero(alive)
        for s in range(0, len(i), part := max(1, CELLS // d)):
            a, b = rows[i[s : s + part]], cols[j[s : s + part]]
            best.add(a, ids[b], np.einsum("ij,ij->i", asked.q[a], c[b]))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of greatest inner product for each query, both as `quantised` gives them; ties to the smaller vec_id."""
    sizes = vectors.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    main = sizes["d"] if sizes and sizes["d"] <= ROTATED else 0
    turn = rotation_of(vectors, main) if main else None
    asked_bytes = queries.agg(F.sum(F.col("d").cast("long") * 8)).first()[0] or 0
    tasks = vectors.sparkSession.sparkContext.defaultParallelism

    # equal vectors are neighbours in this order, and the id lets a frequent vector spread over partitions
    near = ["d", F.col("squared").desc(), F.xxhash64("v")]
    order = [*near, "v", "vec_id"]
    blocks = cut(packed(vectors.repartitionByRange(*near, "vec_id").sortWithinPartitions(*order), block_bytes, k))
    distinct = queries.dropDuplicates(["vec_id", "v"]).repartitionByRange(max(1, -(-asked_bytes // query_bytes)), *near, "vec_id")
    asked = packed(distinct.sortWithinPartitions(*order), query_bytes, None).withColumnsRenamed({c: f"q{c}" for c in ("at", "w", "top", "ids", "data")})
    first = blocks.groupBy("d").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("blocks"))

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floors, reach = [], []
            for x in b.itertuples():
                block = Asked(x.qids, matrix(x.qdata, x.d, x.qw), turn if x.d == main else None)
                best = Best(np.full(len(block.ids), -np.inf), k)
                meet(best, block, numbers(x.ids), matrix(x.data, x.d, x.w))
                floors.append(best.floor.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(block.length > 0, best.floor / block.length, -np.inf)
                reach.append(float(ratio.min()))
            yield b[["d", "qat", "qw", "qids", "qdata"]].assign(floors=floors, reach=reach)

    # one seed block a vector length, of block_bytes at most
    seeds = blocks.join(F.broadcast(first.select("at")), "at").select("d", "w", "ids", "data")
    floored = cut(cut(asked).join(seeds, "d").mapInPandas(seeded, "d int, qat long, qw int, qids binary, qdata binary, floors binary, reach double"))

    # metadata only: how many slabs, and which blocks of queries a block of candidates can still serve by its length
    meta = floored.groupBy("d").agg(F.collect_list(F.struct("qat", "reach")).alias("asked")).join(first.drop("at"), "d").withColumn(
        "slabs", F.greatest(F.ceil(F.col("blocks") / SLAB_BLOCKS), F.least("blocks", F.ceil(F.lit(tasks) / F.size("asked")))).cast("int")
    )
    meets = blocks.join(meta.select("d", "asked", "slabs"), "d").withColumn("slab", F.pmod(F.xxhash64("at"), F.col("slabs").cast("long")).cast("int"))
    meets = meets.withColumn("by", F.explode("asked")).where(F.col("top") * (1 + 2 * SLACK) + SLACK >= F.col("by.reach"))
    none = F.lit(None).cast("binary")
    walks = meets.select("by.qat", "slab", "at", "d", "w", "top", "ids", "data", none.alias("floors")).unionByName(
        floored.join(meta.select("d", "slabs"), "d").select(
            "qat", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"), F.lit(-1).cast("long").alias("at"), "d",
            F.col("qw").alias("w"), F.lit(0.0).alias("top"), F.col("qids").alias("ids"), F.col("qdata").alias("data"), "floors",
        )
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block of queries comes first, then the candidates of a slab from long to short."""
        block = best = at = None

        def found() -> pd.DataFrame:
            q, ids, score = best.rows(np.arange(len(block.ids)))
            return pd.DataFrame({"query_id": block.ids[q], "qat": at, "place": q, "vec_id": ids, "score": score})

        for b in batches:
            for x in b.itertuples():
                if x.at < 0:
                    if block is not None:
                        yield found()
                    at, block = x.qat, Asked(x.ids, matrix(x.data, x.d, x.w), turn if x.d == main else None)
                    best = Best(np.frombuffer(x.floors, dtype=float), k)
                elif asked_any(block, best, x.top):
                    meet(best, block, numbers(x.ids), matrix(x.data, x.d, x.w))
        if block is not None:
            yield found()

    def asked_any(block: Asked, best: Best, top: float) -> bool:
        return bool(block.reaches(best.floor, top * (1 + SLACK)).any())

    rows = walks.repartition("qat", "slab").sortWithinPartitions("qat", "slab", "at").mapInPandas(walk, "query_id long, qat long, place long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qat", "place").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
