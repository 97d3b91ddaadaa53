"""Language identification with word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its character n-grams, from 4 down to 1 with
marks at its ends, at the longest length that has any known n-gram. Word scores are log posteriors, so a word that is as common
in every language says nothing; their sum over a text decides.

The model is learned from a sample of about `SAMPLE_DOCS` documents for each value of `lang`, chosen by a hash of doc_id among those
outside the held-out quarter, and holds at most `VOCABULARY` words and `GRAMS` n-grams of each language; both bounds are parameters.

Defined cases: a null text, or one without letters, is `und` with score 0; without any labelled document every text is `und`; letters
that the model has never seen give the languages equal scores, and the first in order wins; rows repeat as they come; a row
without an id is neither held out nor learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import cut
from .common import packed, unpacked

SAMPLE_DOCS, VOCABULARY, GRAMS, LONGEST = 300, 40_000, 60_000, 4
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Weight of a backed-off word against a known one, and prior counts.
BACKOFF, PRIOR = 0.5, 0.5


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def words_in(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About `per_lang` learnable documents of each language, by a hash of the id."""
    known = docs.where(remainder(F.col("doc_id")) != 2).where("lang IS NOT NULL")
    million = 1_000_000
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(million))
    # one row a language
    sizes = F.broadcast(known.groupBy("lang").agg(F.ceil(F.lit(million * per_lang) / F.count("*")).alias("share")))
    return known.join(sizes, "lang").where(place < F.col("share")).select(docs.columns)


def count_features(docs: DataFrame, vocabulary: int, grams: int) -> list[tuple[str, int, str, int]]:
    """lang, length (0: word), feature, count: the most frequent words and n-grams of each language in the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"]):
                for w, c in Counter(words_in(text)).items():
                    counts[lang, 0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams_of(w[:64], n):
                            counts[lang, n, g] += c
            yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["lang", "len", "feature", "n"])

    rows = docs.where("text IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, len int, feature string, n long")
    total = cut(rows.groupBy("lang", "len", "feature").agg(F.sum("n").alias("n")))
    word = F.col("len") == 0
    rank = F.row_number().over(Window.partitionBy("lang", word).orderBy(F.desc("n"), "feature", "len"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= F.when(word, vocabulary).otherwise(grams)).drop("rank")
    return [tuple(r) for r in best.collect()]


class Model:
    """Log posteriors of the languages by word and by n-gram."""

    def __init__(self, features: list[tuple[str, int, str, int]], langs: list[str]):
        self.langs = langs
        place = {x: i for i, x in enumerate(langs)}
        self.levels: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
        totals = np.full((LONGEST + 1, len(langs)), 1.0)
        raw: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, feature, count in features:
            raw[n].setdefault(feature, np.zeros(len(langs)))[place[lang]] += count
            totals[n, place[lang]] += count
        for n, table in enumerate(raw):
            # the prior is a share of each language's own mass, so that its sample size doesn't matter
            floor = PRIOR * totals[n] / totals[n].max()
            for feature, counts in table.items():
                v = np.log((counts + floor) / totals[n])
                self.levels[n][feature] = (v - np.logaddexp.reduce(v)).tolist()

    def word(self, w: str) -> list[float]:
        known = self.levels[0].get(w)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.levels[n]
            found = [v for g in grams_of(w[:64], n) if (v := table.get(g)) is not None]
            if found:
                weight = BACKOFF * min(len(found), 4) / len(found)
                return [weight * sum(column) for column in zip(*found)]
        return [0.0] * len(self.langs)


class Scores(dict):
    """Row numbers of words in a matrix of scores; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        size = max(10_000, min(200_000, 2_000_000 // len(model.langs)))
        self.model, self.rows = model, np.zeros((size, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        self.rows[k] = self.model.word(word)
        self[word] = k
        return k

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            if len(self) + len(part) > len(self.rows):
                self.clear()
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=float)
        return out


def learn(docs: DataFrame, per_lang: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY, grams: int = GRAMS) -> Model | None:
    features = count_features(sample(docs.select("doc_id", "text", "lang"), per_lang), vocabulary, grams)
    langs = sorted({f[0] for f in features})
    return Model(features, langs) if langs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scores = Scores(m) if m is not None else None
        for texts in batches:
            out = []
            for text in texts:
                words = words_in(text) if isinstance(text, str) else []
                if m is None or not any(c.isalpha() for w in words for c in w):
                    out.append((UNKNOWN, 0.0))
                    continue
                total = scores.total(words)
                best = int(total.argmax())
                out.append((m.langs[best], float(np.exp(total[best] - np.logaddexp.reduce(total)))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    label = F.pandas_udf(run, "lang_pred string, score double")
    return docs.withColumn("_p", label(F.col("text"))).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = learn(docs)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language, with all their columns; where no model can be learned, those with letters."""
    model = learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return unpacked(predict(packed(docs, "text"), model).where(F.col("lang_pred") != UNKNOWN), docs.columns, ("text",))
