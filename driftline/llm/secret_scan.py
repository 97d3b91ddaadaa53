"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers (DataFrame functions only).

Two first-order character models are trained from labelled samples: random strings, made by rule from digests, and ordinary
identifiers, made from words of a bounded sample of documents. A token is reported as `random` if the log-likelihood ratio of
the models exceeds a threshold. The models meet rows as one array of numbers over pairs of the fixed alphabet.

Defined cases: a null or empty text has no spans; repeated rows are judged alike; ids are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, running_totals, unpacked
from .urls import ORDINARY_WORDS

# The patterns of the three base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET)
#: Documents whose words train the model of ordinary identifiers, and strings made for the other model.
SAMPLE_DOCS = 2000
SAMPLE_STRINGS = 6000
#: Least total and mean log-likelihood ratio (natural logarithm) of a secret.
MIN_TOTAL, MIN_MEAN = 12.0, 0.4
#: Weight of the single characters in each row of a model, in counts.
BACKOFF = 20.0
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Spans of all matches, in code points. Gaps between matches come from the same pattern, so lengths give the places."""

    def located(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)
        lengths = F.flatten(
            F.zip_with(gaps, found, lambda g, m: F.array(F.char_length(g).cast("long"), F.coalesce(F.char_length(m), F.lit(0)).cast("long")))
        )
        return let(
            running_totals(lengths),
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(at, 2 * i + 1).alias("start"), F.lit(rank).alias("rank"), (F.get(at, 2 * i + 1) + F.char_length(m)).alias("end"),
                    F.lit(kind).alias("kind"), m.alias("match"),
                ),
            ),
        )

    all_ = let(text, located)
    kept = F.filter(all_, lambda s: keep(s["match"])) if keep is not None else all_
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).cast(SPAN)
    return F.when(text.rlike(pattern), bare).otherwise(no_spans())


def base_spans(text: Column) -> Column:
    return F.sort_array(F.concat(
        spans(text, ASSIGN, "assign", 0, keep=lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 8),
        spans(text, ACCESS, "access", 1), spans(text, HEX, "hex", 2),
    ))


def random_strings(spark, n: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled samples of the random class: digests by number, written in base 64, in hexadecimal and in letters and digits."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, b64).when(F.col("id") % 3 == 1, F.substring(digest, 1, 40)).otherwise(F.translate(b64, "+/=", "")).alias("token")
    )


def identifiers(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples of the ordinary class: words, alone and joined as identifiers are, of about `sample` documents."""
    every = max(1, docs.count() // sample)
    words = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(
        F.filter(F.split("text", "[^A-Za-z0-9+/_=-]+"), lambda w: w.rlike("^[A-Za-z]{3,24}$")).alias("w")
    )
    fixed = docs.sparkSession.createDataFrame([(ORDINARY_WORDS,)], "w array<string>")
    joined = words.unionByName(fixed).select(F.explode("w").alias("a"), (F.xxhash64("a") % 1000).alias("h"), F.element_at("w", 1).alias("b"))
    forms = F.array(
        F.col("a"), F.concat_ws("_", "a", "b"), F.concat_ws("-", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b")),
        F.concat_ws("_", F.upper("a"), F.upper("b")), F.concat("a", F.abs("h").cast("string")), F.concat_ws("/", "a", "b", F.lit("index")),
        F.concat_ws("-", F.lit("2024"), F.lit("01"), "a"), F.concat_ws("=", "a", "b"),
    )
    return joined.select(F.explode(forms).alias("token"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of characters; its size is that of the alphabet squared."""
    spark = docs.sparkSession
    labelled = random_strings(spark).select("token", F.lit(1).alias("label")).unionByName(identifiers(docs, sample_docs).select("token", F.lit(0).alias("label")))
    pairs = labelled.where("length(token) > 1").select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))).alias("pair")
    )
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    single = [{b: sum(counts.get((label, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET} for label in (0, 1)]
    model = []
    for a in ALPHABET:
        logs = []
        for label in (0, 1):
            row, mass = [counts.get((label, a + b), 0) for b in ALPHABET], sum(single[label].values())
            # rare characters fall back on how often the next one occurs at all
            logs.append([math.log((row[k] + BACKOFF * single[label][b] / mass) / (sum(row) + BACKOFF)) for k, b in enumerate(ALPHABET)])
        model += [one - zero for zero, one in zip(*logs)]
    return model


def random_spans(text: Column, model: Column) -> Column:
    """Tokens with letters and digits whose log-likelihood ratio is high."""

    def ratio(m: Column) -> Column:
        chars = F.filter(F.split(m, ""), lambda c: c != "")
        codes = F.transform(chars, lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
        return let(
            codes,
            lambda k: F.aggregate(
                F.zip_with(k, F.slice(k, F.lit(2), F.size(k)), lambda a, b: F.get(model, a * SIDE + b)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))
            ),
        )

    def keep(m: Column) -> Column:
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        return mixed & let(ratio(m), lambda r: (r >= MIN_TOTAL) & (r >= MIN_MEAN * (F.length(m) - 1)))

    return spans(text, TOKEN, "random", 3, keep)


def scan(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """The rows with `base` and `all_spans`, arrays of (start, rank, end, kind). Random tokens that touch a base span are left to it."""
    model = train(docs.select("doc_id", F.col(text).alias("text"))) if model is None else model
    numbers = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")  # folds to one constant
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base", base_spans(t)).withColumn("_more", random_spans(t, numbers))
    apart = F.filter("_more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn("all_spans", F.sort_array(F.concat("base", apart))).drop("_more")


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; texts without spans stay as they are."""

    def step(s: Column, x: Column) -> Column:
        fresh = F.greatest(x["start"], s["upto"])
        gap = F.substr(F.col("text"), (s["upto"] + 1).cast("int"), (fresh - s["upto"]).cast("int"))
        piece = F.when(x["end"] <= s["upto"], F.lit("")).otherwise(F.concat(gap, F.when(x["start"] >= s["upto"], F.lit(mark)).otherwise(F.lit(""))))
        return F.struct(F.concat(s["out"], piece).alias("out"), F.greatest(s["upto"], x["end"]).alias("upto"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))
    done = let(
        F.aggregate("all_spans", zero, step), lambda s: F.concat(s["out"], F.substr(F.col("text"), (s["upto"] + 1).cast("int"), F.lit(2147483647)))
    )
    text = F.when(F.size("all_spans") > 0, done).otherwise(F.col("text"))
    used = ("doc_id", "text")
    return unpacked(scan(packed(docs, *used)).withColumn("text", text), docs.columns, used)
