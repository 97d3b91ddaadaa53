"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled table, made by rule from the fixed words below: every word stands in several places
of a host or path, blocked words against ordinary ones. Host and path are hashed apart. Scoring is array arithmetic in batches.

Defined cases: a null url, or one without `://`, has an empty host and path and meets no rule and an empty feature vector; ties of rule
length cannot occur for one host and path, except for repeated rules; repeated rows are judged alike; ids may repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# The rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]

# Words of the labelled table.
BLOCKED_WORDS = (
    "casino poker bets betting slots jackpot roulette porn xxx sex adult nude escort cams pills viagra cialis pharmacy-cheap warez crack keygen torrent "
    "free-bets casino-win win-prize ads-track tracker popunder clickbank adserver banner-ads spam phishing malware lottery payday loans replica-watches "
    "hot-singles dating-now get-rich crypto-double free-iphone prize-claim cheap-meds online-casino free-spins"
).split()
ORDINARY_WORDS = (
    "news blog docs wiki school university library science history music garden travel kitchen recipes weather sport museum city council health family "
    "books journal research project community forum support help about contact articles archive stories photo nature energy market business law "
    "technology software design education reading culture theatre football cycling mountain river ocean street village"
).split()
SYLLABLES = "th tion er an re in on at nd st es en of te ed or ti hi as to ea ng ou le ha".split()

BITS, SHORTEST, LONGEST = 14, 2, 5
EPOCHS, RATE, DECAY = 300, 2.0, 1e-4


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; (rule, verdict) or null."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def labelled() -> list[tuple[str, str, int]]:
    """host, path, label (1: block): a small table made from the words."""
    out = []
    tops = ("example.com", "example.net", "example.org", "com", "net", "org", "info", "co.uk")
    for label, words in ((1, BLOCKED_WORDS), (0, ORDINARY_WORDS)):
        for i, w in enumerate(words):
            top, s = tops[i % len(tops)], SYLLABLES[i % len(SYLLABLES)]
            out += [
                (f"{w}.{top}", f"/en/{1000 + 37 * i}", label), (f"www.{w}.{tops[(i + 3) % len(tops)]}", "/", label), (f"m.{w}{i}.{top}", f"/de/{i}.html", label),
                (f"blog.{s}{w}.{top}", f"/fr/{11 * i}/", label), (f"{s}{SYLLABLES[(i + 5) % len(SYLLABLES)]}.{top}", f"/{w}/{i}", label),
            ]
    for i, a in enumerate(SYLLABLES):
        for j, b in enumerate(SYLLABLES):
            if (i + j) % 3 == 0:
                lang = ("en", "de", "fr", "es")[(i + j) % 4]
                out.append((f"{('', 'www.', 'm.', 'blog.')[i % 4]}{a}{b}.{tops[j % 3]}", f"/{lang}/{97 * i + j}{('', '/', '.html')[j % 3]}", 0))
    return out


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        for n in range(SHORTEST, LONGEST + 1):
            found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "replace")) >> (32 - BITS) for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def train(table: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent; each example has unit length, and both classes weigh alike."""
    rows = [features(h, p) for h, p, _ in table]
    y = np.array([label for *_, label in table], float)
    place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows)
    value = np.repeat([1 / np.sqrt(max(len(r), 1)) for r in rows], [len(r) for r in rows])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(EPOCHS):
        z = np.bincount(place, value * w[column], len(rows)) + bias
        g = share * (1 / (1 + np.exp(-z)) - y)
        w -= RATE * len(SYLLABLES) * (np.bincount(column, value * g[place], 1 << BITS) + DECAY * w)
        bias -= RATE * g.sum()
    return w, bias


def block_probability(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    w, bias = model

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            z = [w[f].sum() / np.sqrt(max(len(f), 1)) + bias for f in map(features, hosts, paths)]
            yield pd.Series(1 / (1 + np.exp(-np.array(z, float))))

    return score(host, path)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, p_block."""
    host, path = host_path(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    x = x.withColumn("p_block", block_probability(F.col("host"), F.col("path"), train(labelled()))).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "p_block")
