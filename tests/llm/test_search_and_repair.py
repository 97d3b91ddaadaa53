"""Exact top-k products, ranked lexical search and conversation repair against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import conversations, inner_products, lexical_search

VECTORS = "vec_id long, embedding array<float>, label string, v string, d string, at string, ids string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "l", "v", "d", "a", "i") for i, v in rows], VECTORS)


def brute_products(rows, k=10):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({(i, tuple(v)) for i, v in fine if i % 100 == 0}):
        found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def products(df, **sizes):
    v = inner_products.quantised(df)
    return sorted(tuple(r) for r in inner_products.top_products(v, v.where("vec_id % 100 = 0"), **sizes).collect())


def test_products_brute(spark):
    rng = np.random.RandomState(1)
    rows = [(i, (rng.randn(6) * 2.0 ** rng.randint(-3, 4)).tolist()) for i in range(450)]
    same = rng.randn(6).tolist()
    rows += [(1000 + 50 * (i // 3), same) for i in range(90)]  # copies and repeated rows, queries among them
    rows += [(100, rows[100][1]), (200, same), (700, [1.0, 2.0]), (701, [3.0, -1.0]), (800, [1e6, -1e6]), (900, []), (901, None), (None, same)]
    rows += [(902, [float("nan")] * 6), (903, [float("inf")] * 6), (1200, [None] + [1.0] * 5), (300, [0.0] * 6), (1300, [0.25] * 3)]
    want = brute_products(rows)
    for sizes in ({}, {"block_bytes": 1000, "query_bytes": 200}):
        assert products(vectors_of(spark, rows), **sizes) == want
    assert products(vectors_of(spark, rows[:4])) == brute_products(rows[:4])
    assert products(vectors_of(spark, [])) == []


def test_products_keep_few_of_many_copies(spark):
    rows = vectors_of(spark, [(i, [1.0, 2.0]) for i in range(1000)])
    v = inner_products.quantised(rows).repartition(1).sortWithinPartitions("vec_id")
    kept = sum(len(inner_products.numbers(r["ids"])) for r in inner_products.packed(v, 1 << 20, 10).collect())
    assert kept <= 20
    assert products(rows) == [(q, r + 1, i, 1024 * 1024 * 5) for q in range(0, 1000, 100) for r, i in enumerate([x for x in range(11) if x != q][:10])]


def test_bounds_leave_pairs_unscored(spark):
    rng = np.random.RandomState(2)
    q = rng.randint(-500, 500, (20, 32)) * np.r_[np.ones(4), np.full(28, 0.02)]
    c = rng.randint(-500, 500, (3000, 32)) * np.r_[np.ones(4), np.full(28, 0.02)]
    q, c = q.astype(np.int64), c.astype(np.int64)
    scored = []

    class Watched(inner_products.Best):
        def add(self, rows, ids, score):
            scored.append(len(rows))
            super().add(rows, ids, score)

    best = Watched(np.full(20, -np.inf), 10)
    asked = inner_products.Asked(np.arange(20).tobytes(), q, np.eye(32))
    for lo in range(0, 3000, 500):
        inner_products.meet(best, asked, 100 + np.arange(lo, lo + 500), c[lo : lo + 500])
    assert sum(scored) < 0.05 * 20 * 3000
    assert (best.score == -np.sort(-(q @ c.T), axis=1)[:, :10]).all()


DOCS = "doc_id long, text string, lang string, n long, terms string, tfs string, place string"
TEXTS = [
    (1, "The cat and the dog"), (2, "the the the cat"), (3, None), (4, ""), (5, "!!! ..."), (6, "dog " * 500), (7, "été ÉTÉ Été cat"), (8, "The cat and the dog"),
    (9, "cat\x00dog_bird 42"), (None, "cat dog bird"), (None, "cat dog bird"), (10, "x" * 50000 + " bird"), (11, "ünïcode cat İ"), (2, "another cat"),
]
ITEMS = [(1, "cat"), (2, "Cat cat DOG bird"), (3, ""), (4, None), (5, "nothing here matches"), (1, "cat"), (1, "dog"), (None, "the 42"), (6, "été cat " + " ".join(f"w{i}" for i in range(200)) + " the")]


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(texts, items, k=20):
    docs = [(i, Counter(terms_of(t))) for i, t in texts]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item or -1, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranking(docs, items, **kw):
    return sorted(((r["item_id"] or -1, r["rank"], r["doc_id"], r["score"]) for r in lexical_search.top_documents(docs, items, **kw).collect()), key=str)


def test_lexical_search_brute(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", 1, "t", "f", "p") for i, t in TEXTS], DOCS)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, terms string")
    for k, limit in ((20, 1 << 20), (3, 1 << 20), (3, 10)):
        assert ranking(docs, items, k=k, block_bytes=limit) == brute_ranking(TEXTS, ITEMS, k)
    assert ranking(docs.where("false"), items) == ranking(docs, items.where("false")) == []


@pytest.mark.parametrize("cells", [1 << 20, 3000])
def test_lexical_batches_brute(cells, monkeypatch):
    """Masks of more than 64 terms, small batches, ties: the ranking of batches equals that of all scores."""
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rng = np.random.RandomState(4)
    for terms in (3, 70, 200):
        r, value = lexical_search.Ranking(7), rng.randint(0, 5000, terms)
        tf = rng.randint(0, 4, (terms, 900)) * (rng.rand(terms, 900) < 0.1)
        tf[:, 300:600] = tf[:, :300]
        m, ids = np.tile(75 + rng.randint(0, 3, 300) * 25, 3), rng.permutation(900)
        for lo in (0, 450):
            part = slice(lo, lo + 450)
            lexical_search.rank_batch(r, tf[:, part].astype(np.int64), value, m[part], np.zeros(450, bool), ids[part])
        score = (value[:, None] * lexical_search.impact(tf.astype(np.int64), m)).sum(axis=0)
        want = sorted((-s, i) for s, i in zip(score, ids) if s > 0)[:7]
        assert [(-s, i) for s, i in zip(r.score, r.id)] == want


def test_long_texts_are_split_between_terms(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(3000))
    want = Counter(terms_of(text))
    monkeypatch.setattr(lexical_search, "PART", 50)
    assert lexical_search.counted(text) == want


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def brute_repair(rows, gaps=("", "u", "a")):
    """All edit sequences: per row keep, rerole either way or delete, and up to some inserts in every gap."""
    faults, best = faults_of(rows), None
    options = [[("D", 3, None)] if f in ("blank", "duplicate") else [
        ("D", 3, None), ("K", f == "truncated", (r, t)), ("R", 2 + (f == "truncated"), ("user", t)), ("R", 2 + (f == "truncated"), ("assistant", t)),
    ] for f, (_, r, t) in zip(faults, rows)]
    for inserted in itertools.product(gaps, repeat=len(rows) + 1):
        base = 2 * sum(map(len, inserted))
        if best and base > best[0]:
            continue
        for chosen in itertools.product(*options):
            cost = base + sum(c[1] for c in chosen)
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for k, gap in enumerate(inserted):
                audit += "I" * len(gap)
                out += [("user" if g == "u" else "assistant", "") for g in gap]
                if k < len(rows):
                    audit += chosen[k][0]
                    out += [chosen[k][2]] if chosen[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def brute_report(rows):
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, out = brute_repair(rows) if rows else (0, "", [])
    turns, faults = [t for t, _, _ in rows if t is not None], faults_of(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


TALK = "conv_id long, turn long, role string, text string, place string, edit string, kind string"


def talk_of(spark, rows):
    return spark.createDataFrame([(*r, "p", "e", "k") for r in rows], TALK)


def test_repair_brute(spark):
    rng = np.random.RandomState(6)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["a.", "b?", "cut", "", " \t", None, "c!", "d.", "e.", "f. \n"]
    rows = [(c, [None, 2, 5, 1 << 60][rng.randint(4)] if rng.rand() < 0.1 else t, roles[rng.randint(8)], texts[rng.randint(10)]) for c in range(150) for t in range(rng.randint(1, 5))]
    rows += [(None, 1, "user", "x."), (None, 2, "user", "y."), (1 << 60, 1, "assistant", "\U0001f600 é")]
    want = {}
    for c, *row in rows:
        want.setdefault(c, []).append(tuple(row))
    want = {c: brute_report(r) for c, r in want.items()}
    for budget in (1 << 20, 1):
        repaired = conversations.repair(talk_of(spark, rows), budget=budget)
        got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(repaired).collect()}
        assert got == want
    turns = {}
    for r in sorted(repaired.where("kind = 'turn'").collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append(r)
    for c, report in want.items():
        assert "".join(r["edit"] for r in turns[c]) == report[6]
        said = "\n".join(f"{r['role']}:{r['text']}" for r in turns[c] if r["edit"] != "D")
        assert hashlib.sha256(said.encode()).hexdigest() == report[7]
    assert conversations.repair(talk_of(spark, [])).count() == 0


def test_absent_rows_name_their_conversation(spark):
    rows = talk_of(spark, [(1, 1, "user", "x."), (2, 1, "user", "x."), (2, 3, "assistant", "y.")])
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(conversations.repair(rows, present=F.expr("conv_id = 2 AND turn = 3"))).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2][5:7] == (2, "IK")


def test_giant_conversation_spills(spark):
    n = 30_000
    big = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("says "), (F.col("id") % 20_000).cast("string"), F.lit(".")).alias("text"),
    )
    got = conversations.report(conversations.repair(big, budget=4096)).first()
    assert (got["duplicate"], got["cost"], got["audit"]) == (10_000, 30_000, "K" * 20_000 + "D" * 10_000)
