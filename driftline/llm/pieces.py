"""SentencePiece encoding and decoding with exact n-best segmentations.

A text's lattice has a node at each character border and an edge for each piece of the vocabulary, and for each character that no piece
spells, its bytes. A forward Viterbi pass gives every node the best score from the start; a backward A* search from the end uses
these scores as exact estimates of what is left, so it takes paths off its agenda in order of their full score.

Between two neighbours that stand together in no piece the lattice always has a border, so it falls into parts, and a text's segmentations are
combinations of its parts'. The forward pass, which also keeps the second-best score, runs once for each distinct part; the search
runs only for the few parts whose second choice costs least, which are all that n-best texts can need.

The vocabulary file is read where the driver runs and its path is a parameter. Nothing is normalised and no mark is put in front, so
decoding returns the text exactly. A literal space mark is spelled in bytes. Of equal scores, the forward pass keeps the one whose last piece
is longest, and the search those that reach the start first.

The second and later segmentations are given by what they change in the ids of the best one (`changed_ids` applies it).

Defined cases: a null text has null ids; an empty one has no ids, score 0 and one segmentation; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 3
SPACE, LITERAL = "▁", "\udc81"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Parts that a worker remembers, and parts with all their choices.
PARTS, CHOICES = 400_000, 25_000


class Vocabulary:
    """Pieces with scores; bytes cost more than any piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.bytes = {int(m.group(1), 16): i for i, (p, _) in enumerate(pieces) if (m := BYTE.fullmatch(p))}
        special = {"<unk>", "<s>", "</s>", ""}
        self.ids = {p: (i, s) for i, (p, s) in enumerate(pieces) if p not in special and not BYTE.fullmatch(p)}
        #: every beginning of a piece, with the piece's id and score where it is one
        self.begin = {p[:k]: None for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        #: the same by single characters: id and score where a piece ends, and the steps from there
        self.steps = self.grow()
        #: pairs of neighbours inside pieces; between other characters the lattice always has a border
        self.joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        pairs = sorted({ord(p[0]) << 32 | ord(p[1]) for p in (j.replace(SPACE, " ") for j in self.joints)})
        #: the joints by code points: a table for Latin letters and the space mark, a sorted list for all
        self.table, self.pairs = np.zeros(1 << 16, bool), np.array(pairs, np.uint64)
        self.table[[p >> 24 | p & 255 for p in pairs if p >> 32 < 256 and p & 0xFFFFFFFF < 256]] = True
        self.byte_score = min((s for _, s in self.ids.values() if s > -1e8), default=0.0) - 10.0
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [spelled.get(i, p.replace(SPACE, " ").encode() if p not in special else b"") for i, (p, _) in enumerate(pieces)]

    def grow(self) -> dict:
        below: dict[str, dict] = {"": {}}
        for p in sorted(self.begin):
            below[p] = {}
            below[p[:-1]][p[-1]] = (*(self.begin[p] or (None, 0.0)), below[p])
        return below[""]

    def spell(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = (SPACE if char == LITERAL else char).encode("utf-8", "replace")
        return tuple(self.bytes[b] for b in raw), self.byte_score * len(raw)

    def parts(self, text: str) -> list[str]:
        """The text, with space marks, between neighbours that no piece joins. Its segmentations are combinations of its parts'."""
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(a):
            return []
        x, y = a[:-1], a[1:]
        low = (x | y) < 256
        if low.all():
            joined = self.table[x << 8 | y]
        else:
            joined = np.zeros(len(x), bool)
            joined[low] = self.table[x[low] << 8 | y[low]]
            wide = x[~low].astype(np.uint64) << np.uint64(32) | y[~low]
            at = np.minimum(np.searchsorted(self.pairs, wide), len(self.pairs) - 1)
            joined[~low] = self.pairs[at] == wide if len(self.pairs) else False
        text = text.replace(" ", SPACE)
        ends = (np.flatnonzero(~joined) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])]

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each border, the edges that end there: start, ids, score."""
        n, begin, out = len(unit), self.begin, [[] for _ in range(len(unit) + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                got = begin.get(unit[i:j], False)
                if got:
                    out[j].append((i, (got[0],), got[1]))
                elif j == i + 1:
                    out[j].append((i, *self.spell(unit[i])))
                if got is False:
                    break
        return out


def best_two(unit: str, v: Vocabulary) -> tuple[tuple[int, ...], float, float]:
    """Ids and score of the best segmentation, and by how much the second one is worse (infinite: there is none)."""
    n = len(unit)
    low = float("-inf")
    first, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
    first[0] = 0.0
    steps = v.steps
    for i in range(n):
        f, s, step, j = first[i], second[i], steps, i
        for char in unit[i:]:
            j += 1
            got = step.get(char)
            if got is not None:
                edge, score, step = got
            elif j == i + 1:
                edge, step = None, None
            else:
                break
            if edge is None:
                if j > i + 1:
                    continue
                edge, score = v.spell(char)
            x = f + score
            if x > first[j]:
                y = s + score
                second[j] = first[j] if first[j] > y else y
                first[j], back[j] = x, (i, edge)
            elif x > second[j]:
                second[j] = x
            if not step:
                break
    path, j = [], n
    while j:
        i, edge = back[j]
        if edge.__class__ is int:
            path.append(edge)
        else:
            path += reversed(edge)
        j = i
    path.reverse()
    return tuple(path), first[n], first[n] - second[n]


def n_best(unit: str, v: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations, best first: backward A* with the forward scores as exact estimates."""
    edges = v.edges(unit)
    best = [0.0] + [float("-inf")] * len(unit)
    for j in range(1, len(unit) + 1):
        best[j] = max(best[i] + s for i, _, s in edges[j])
    # of equal costs, the path that has come furthest goes first; paths are linked, so that long ones share what they have
    agenda, out, made = [(-best[-1], len(unit), 0, 0.0, None)], [], 0
    while agenda and len(out) < n:
        cost, j, _, behind, path = heapq.heappop(agenda)
        if j == 0:
            ids: list[int] = []
            while path is not None:
                edge, path = path
                ids += edge
            out.append((-cost, tuple(ids)))
            continue
        for i, edge, s in edges[j]:
            made += 1
            heapq.heappush(agenda, (-(best[i] + s + behind), i, made, behind + s, (edge, path)))
    return out


def units_of(text: str) -> list[str]:
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    if "  " in text:
        return UNIT.findall(text.replace(" ", SPACE))
    first, *rest = text.split(" ")
    units = [SPACE + w for w in rest]
    return [first, *units] if first else units


Known = tuple[bytes, float, float, bool]
#: Start and number of the ids of the best segmentation that go, and the ids that take their place.
Edit = tuple[int, int, tuple[int, ...]]


class Encoder:
    def __init__(self, v: Vocabulary, best: int = BEST):
        self.v, self.best = v, best
        #: of parts: ids (4 bytes each), score, loss of the second choice, and whether the ids spell the source
        self.seen: dict[str, Known] = {}
        self.more: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def spells(self, ids: Iterable[int], text: str) -> bool:
        spelled = self.v.spelled
        return b"".join([spelled[i] for i in ids]) == text.encode("utf-8", "replace")

    def part(self, p: str) -> Known:
        ids, score, gap = best_two(p, self.v)
        got = array("i", ids).tobytes(), score, gap, self.spells(ids, p.replace(SPACE, " ").replace(LITERAL, SPACE))
        if len(p) <= 64:
            if len(self.seen) >= PARTS:
                self.seen.clear()
            self.seen[p] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, float, list[float], list[list[Edit]], bool]:
        """ids, score, the scores of the n best segmentations, what all but the best change in the ids, and whether the ids spell the text."""
        units = self.v.parts(text)
        counts = Counter(units)
        seen = self.seen
        known = {u: seen.get(u) or self.part(u) for u in counts}
        ids = np.frombuffer(b"".join([known[u][0] for u in units]), np.int32)
        # a text is spelled if all its units are
        exact = all([k[3] for k in known.values()]) or self.spells(ids, text)
        score = sum(known[u][1] * c for u, c in counts.items())
        top = self.choices(counts, known)
        places: dict[tuple[str, int], int] = {}
        edits = [sorted((self.place(units, known, u, o, places), len(known[u][0]) // 4, new) for u, o, new in changes) for _, changes in top[1:]]
        return ids, score, [score - d for d, _ in top], edits, exact

    @staticmethod
    def place(units: list[str], known: dict, u: str, nth: int, places: dict[tuple[str, int], int]) -> int:
        """Where the ids of the nth occurrence of a unit start."""
        if (u, nth) not in places:
            at = -1
            for _ in range(nth + 1):
                at = units.index(u, at + 1)
            places[u, nth] = sum([len(known[w][0]) for w in units[:at]]) // 4
        return places[u, nth]

    def choices(self, counts: Counter, known: dict) -> list[tuple[float, tuple[tuple[str, int, tuple[int, ...]], ...]]]:
        """What the n best texts lose against the best one, and the units they change: unit, occurrence, new ids. Only the n - 1 units
        with the cheapest second choice can differ in them."""
        cheap = heapq.nsmallest(self.best - 1, ((known[u][2], u) for u in counts))
        total: list = [(0.0, ())]
        for gap, u in cheap:
            if gap == float("inf"):
                break
            own, score = tuple(memoryview(known[u][0]).cast("i")), known[u][1]
            # of equal scores the search may take another first, so the best one is told by its ids
            mine = [(max(0.0, score - s), new) for s, new in self.alternatives(u) if new != own][: self.best - 1]
            for o in range(min(counts[u], self.best - 1)):
                more = [(a + b, (*changes, (u, o, new))) for a, changes in total for b, new in mine]
                total = heapq.nsmallest(self.best, [*total, *more])
        return total

    def alternatives(self, u: str) -> list[tuple[float, tuple[int, ...]]]:
        got = self.more.get(u)
        if got is None:
            if len(self.more) >= CHOICES:
                self.more.clear()
            got = self.more[u] = n_best(u, self.v, self.best)
        return got


def segmentations(text: str, v: Vocabulary, n: int = BEST) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a whole text with their ids, units combined best first."""
    lists = [n_best(u, v, n) for u in units_of(text)]
    total: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for mine in lists:
        total = heapq.nsmallest(n, ((c - s, ids + more) for c, ids in total for s, more in mine))
    return [(-c, list(ids)) for c, ids in total]


def changed_ids(ids: list[int], edits: list) -> list[int]:
    """The ids of a further segmentation, from those of the best one and an element of `others`."""
    out, last = [], 0
    for start, count, new in edits:
        out += [*ids[last:start], *new]
        last = start + count
    return out + ids[last:]


def load(path: str = MODEL) -> list[tuple[str, float]]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


_encoders: dict[tuple[int, bytes], Encoder] = {}


def encoder(pieces: list[tuple[str, float]], best: int) -> Encoder:
    """One per worker process and model, so that tasks share what earlier ones have seen."""
    key = best, hashlib.blake2b(repr(pieces).encode()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(pieces), best)
    return _encoders[key]


FIELDS = "ids array<int>, n_pieces long, score double, best_scores array<double>, others array<array<struct<start:int,count:int,ids:array<int>>>>, exact boolean"
RESULTS = ("ids", "n_pieces", "score", "best_scores", "others", "exact")
OTHERS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encode(docs: DataFrame, path: str = MODEL, best: int = BEST, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with ids, n_pieces, score, best_scores, others (what the second to n-th best segmentations change in ids)
    and exact (decoding returns the text). A named column that is called like one of these gets `given_` before its name."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    carried = [F.col(f"`{n}`").alias(f"given_{n}" if n in RESULTS else n) for n in names]
    schema = docs.select(F.struct(*carried).alias("given")).schema
    schema = StructType([*schema, *StructType.fromDDL(FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value, best)
        for whole in batches:
            for b in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                flat, ends, scores, bests, others, exact = [], [0], [], [], [], []
                given, texts = b.column(0), b.column(1).to_pylist()
                for text in texts:
                    if text is None:
                        ends.append(ends[-1])
                        scores.append(None)
                        bests.append(None)
                        others.append(None)
                        exact.append(None)
                        continue
                    ids, score, top, edits, spelled = e.encode(text)
                    exact.append(spelled)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    scores.append(score)
                    bests.append(top)
                    others.append(edits)
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32), mask=np.append(null, False)), values)
                counts = pa.array(np.diff(ends), pa.int64(), mask=null)
                columns = [given, lists, counts, pa.array(scores, pa.float64()), pa.array(bests, pa.list_(pa.float64()))]
                columns += [pa.array(others, OTHERS), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["given", *RESULTS])

    return docs.select(F.struct(*carried).alias("given"), "text").mapInArrow(run, schema).select("given.*", *RESULTS)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows with `decoded`, the text of `ids`."""
    spelled = rows.sparkSession.sparkContext.broadcast(Vocabulary(load(path)).spelled)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else b"".join([spelled.value[i] for i in x]).decode("utf-8", "replace") for x in ids], dtype=object)

    return rows.withColumn("decoded", text("ids"))
