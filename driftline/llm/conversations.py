"""Conversation structure repair by a streaming edit-distance programme.

Rows are dealt out by conversation and sorted by turn inside each partition, so a conversation arrives at one `mapInPandas` call in
order, over as many Arrow batches as it takes. The programme walks its rows once. It keeps four states (nothing yet, after system, after
user, after assistant) with the least cost of reaching each, the order of their edit strings, and 3 bytes of backpointers a row. Rows,
backpointers and the digests of texts seen move to an unlinked file of the task beyond `SPILL_BYTES`, so memory doesn't grow with a
conversation. At its end the backpointers are followed back, the rows are replayed forward, and the repaired turns leave in batches.

Wanted are the role initials `(s?(ua)+)?`. Edits: K keeps a row (cost 0), R sets its role to what is due (2), D deletes it (3), I inserts an
empty turn of the role that is due (2); an undeleted truncated row costs 1 more. Blank and duplicate rows must go. The cheapest
edits win, of equal ones the ASCII-least string.

Why four states and ranks are enough: due after nothing, system or assistant is a user, after a user an assistant, so an edit string
fixes its state. A cheapest and least string has inserts only right in front of K or R (`ID` costs as much as `DI` and is greater; two
inserts in a row lead nowhere new) or at the very end. The tokens D, K, R, IK, IR form a prefix code, so of two strings over equally many
rows the one that was less stays less, and their rank replaces the strings.

Defined cases: a null role or text is one space; null turns come first; a null id is a conversation of its own; rows of one turn are ordered by role and
text; equal rows are duplicates of the first; a conversation without present rows has zeros, no audit and the digest of the empty
string; an empty table gives no rows. Only the named columns are read, so further columns can have any name.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes a conversation may hold in memory before it moves to the task's file.
SPILL_BYTES = 32 << 20
OUT_ROWS = 5000

NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: state -> initial -> next state, as the row stands.
STEP = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
TOKENS = ("D", "IK", "IR", "K", "R")  # in ASCII order
LEGAL = {"su", "ua", "au"}
#: What completes the roles at the end.
CLOSE = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
BLANKS = " \t\n\x0b\x0c\r"
DEAD = 1 << 60


def moves(initial: str) -> list[list[tuple[int, int, int]]]:
    """For each target state the (source, token number, cost) that lead there over a row with this role initial."""
    into: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for x in range(4):
        into[x].append((x, 0, 3))
        for inserted, extra in ((False, 0), (True, 2)):
            at = DUE[x] if inserted else x
            kept = STEP[at].get(initial)
            if kept is not None:
                into[kept].append((x, 1 if inserted else 3, extra))
            into[DUE[at]].append((x, 2 if inserted else 4, extra + 2))
    return into


class Spill:
    """Records in order: in memory up to a budget, the older ones in a file that only this task sees and that vanishes with it."""

    def __init__(self, budget: int):
        self.budget, self.held, self.bytes, self.file, self.marks = budget, [], 0, None, []

    def add(self, record, size: int) -> None:
        self.held.append(record)
        self.bytes += size
        if self.bytes > self.budget:
            self.flush()

    def flush(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.marks.append(self.file.tell())
        pickle.dump(self.held, self.file, protocol=pickle.HIGHEST_PROTOCOL)
        self.held, self.bytes = [], 0

    def blocks(self, backwards: bool = False) -> Iterator[list]:
        if backwards:
            yield self.held
        for mark in reversed(self.marks) if backwards else self.marks:
            self.file.seek(mark)
            yield pickle.load(self.file)
        if not backwards:
            yield self.held

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Seen:
    """Which digests came before: a set, and sorted runs of 16-byte digests in a file once it is full."""

    def __init__(self, budget: int):
        self.limit, self.recent, self.runs = max(budget // 128, 16), set(), []

    def test_and_add(self, digest: bytes) -> bool:
        if digest in self.recent or any(self._in(run, digest) for run in self.runs):
            return True
        self.recent.add(digest)
        if len(self.recent) >= self.limit:
            self._settle()
        return False

    @staticmethod
    def _in(run: np.ndarray, digest: bytes) -> bool:
        key = np.frombuffer(digest, dtype=np.uint64)
        lo, hi = np.searchsorted(run[0], key[0], "left"), np.searchsorted(run[0], key[0], "right")
        return bool((run[1][lo:hi] == key[1]).any())

    def _settle(self) -> None:
        new = np.frombuffer(b"".join(self.recent), dtype=np.uint64).reshape(-1, 2).T
        # runs of a similar size are merged, so there are only logarithmically many
        while self.runs and self.runs[-1].shape[1] <= new.shape[1]:
            new = np.concatenate([new, self.runs.pop()], axis=1)
        file = tempfile.TemporaryFile()
        np.ascontiguousarray(new[:, np.argsort(new[0])]).tofile(file)
        file.flush()
        self.runs.append(np.memmap(file, dtype=np.uint64, mode="r", shape=new.shape))
        self.recent = set()


class Conversation:
    """The state of one conversation while its rows pass by."""

    def __init__(self, conv_id, budget: int, cache: dict):
        self.id, self.cache = conv_id, cache
        self.rows, self.back, self.seen = Spill(budget), Spill(budget // 4), Seen(budget // 4)
        self.cost, self.rank = [0, DEAD, DEAD, DEAD], [0, 0, 0, 0]
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.turn
            self.high = self.turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        said = text.rstrip(BLANKS)
        fault = ""
        # the role's length in front keeps ("a", "b:c") and ("a:b", "c") apart
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if not said:
            fault = "blank"
        elif self.seen.test_and_add(digest):
            fault = "duplicate"
        elif said[-1] not in ".!?":
            fault = "truncated"
        if fault:
            self.faults[fault] += 1
        self._advance(initial, fault)
        self.rows.add((turn, role, text, fault), 2 * len(text) + len(role) + 200)

    def _advance(self, initial: str, fault: str) -> None:
        gone = fault in ("blank", "duplicate")
        more = 1 if fault == "truncated" else 0
        cost, rank, packed, best = [DEAD] * 4, [0] * 4, 0, []
        if gone:
            into = [[(x, 0, 3)] for x in range(4)]
        else:
            into = self.cache.get(initial)
            if into is None:
                into = self.cache[initial] = moves(initial)
        for y in range(4):
            # of equal costs the least string: first by the string so far, then by the new token
            least = min(
                ((self.cost[x] + c + (more if t else 0), self.rank[x], t, x) for x, t, c in into[y] if self.cost[x] < DEAD), default=None
            )
            if least is not None:
                cost[y] = least[0]
                best.append((least[1], least[2], y))
                packed |= (least[3] << 3 | least[2]) << (6 * y)
        for k, (_, _, y) in enumerate(sorted(best)):
            rank[y] = k
        self.cost, self.rank = cost, rank
        self.back.add(packed.to_bytes(3, "little"), 36)

    def tokens(self) -> tuple[int, str, Spill]:
        """Cost, what closes the roles, and the token numbers from the last row to the first."""
        cost, _, state = min((c + 2 * len(CLOSE[s]), self.rank[s], s) for s, c in enumerate(self.cost) if c < DEAD)
        closing, path = CLOSE[state], Spill(self.back.budget)
        for block in self.back.blocks(backwards=True):
            found = bytearray()
            for packed in reversed(block):
                entry = int.from_bytes(packed, "little") >> (6 * state) & 63
                found.append(entry & 7)
                state = entry >> 3
            path.add(bytes(found), len(found) + 40)
        return cost, closing, path

    def finish(self) -> Iterator[tuple]:
        """The repaired turns (turn, role, text, edit, fault), deleted rows among them, then ("report", values)."""
        cost, closing, path = self.tokens()
        digest, audit, first, state = hashlib.sha256(), [], True, NONE

        def said(role: str, text: str) -> None:
            nonlocal first
            digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
            first = False

        steps = (t for block in path.blocks(backwards=True) for part in reversed(block) for t in reversed(part))
        for block in self.rows.blocks():
            for turn, role, text, fault in block:
                token = TOKENS[next(steps)]
                audit.append(token)
                if token[0] == "I":
                    state = DUE[state]
                    said(NAMES[state], "")
                    yield None, NAMES[state], "", "I", None
                if token[-1] == "D":
                    yield turn, role, text, "D", fault or None
                    continue
                if token[-1] == "R":
                    state = DUE[state]
                    role = NAMES[state]
                else:
                    state = STEP[state][role[:1]]
                said(role, text)
                yield turn, role, text, token[-1], fault or None
        for edit in closing:
            state = DUE[state]
            said(NAMES[state], "")
            yield None, NAMES[state], "", edit, None
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        for kept in (self.rows, self.back, path):
            kept.close()
        yield "report", (gaps, *self.faults.values(), self.illegal, cost, "".join(audit) + closing, digest.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None,
    turns: bool = True, budget: int = SPILL_BYTES,
) -> DataFrame:
    """Repaired turns and one report per conversation, told apart by `kind`.

    kind "turn": `place` (from 0), turn, role, text, edit (K, R, I, or D for a row that goes) and fault. kind "report": gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. `turns=False` leaves the turns out. Rows that aren't `present` only name their conversation.
    """
    rows = conversations.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    longs = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv string, kind string, place long, turn long, role string, text string, edit string, fault string, {longs}, audit string, repaired_sha256 string"
    names = [s.strip().split()[0] for s in schema.split(",")]

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        out: list[tuple] = []
        now: Conversation | None = None

        def table() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=names, dtype=object)
            out.clear()
            return frame

        def ended(c: Conversation) -> Iterator[pd.DataFrame]:
            place = 0
            for item in c.finish():
                if item[0] == "report":
                    out.append((c.id, "report", None, None, None, None, None, None, *item[1]))
                elif turns:
                    out.append((c.id, "turn", place, *item, *[None] * 8))
                    place += 1
                if len(out) >= OUT_ROWS:
                    yield table()

        for batch in batches:
            at = [None if x is None else int(x) for x in batch["turn"].tolist()]
            for i, t, r, x, there in zip(batch["conv"].tolist(), at, batch["role"].tolist(), batch["text"].tolist(), batch["present"].tolist()):
                if now is None or i != now.id:
                    if now is not None:
                        yield from ended(now)
                    now = Conversation(i, budget, cache)
                if there:
                    now.add(t, r, x)
        if now is not None:
            yield from ended(now)
        if out:
            yield table()

    # next to nulls, ids and turns above 2**53 would lose digits as pandas floats, so they travel as text
    found = ordered.withColumn("turn", F.col("turn").cast("string")).mapInPandas(flow, schema)
    return found.select(F.col("conv").cast(conversations.schema[conv].dataType).alias(conv), *names[1:])


def report(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    return repaired.where("kind = 'report'").select(conv, *COUNTS, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted damage, drawn by the checksum of `conv_id:turn`; dropped rows stay with present = false."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(word("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")
