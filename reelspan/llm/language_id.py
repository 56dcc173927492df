"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the whole text (A-Z lowered), square-rooted and of unit length.
The machines are fitted on the driver from at most `SAMPLE` labelled documents of each language
(a bounded sample, taken by hash over all labelled documents); everything else sees every document.

Beside the language stands `known`: the share of the text's trigrams that are among the commonest of
that language, those that make up `MASS` of its sample. `keep_identified` rejects texts whose share lies
less than a quarter of the way (`BETWEEN`) from what chance gives to the sample's median: other languages and scripts, codes, symbol noise.

Defined results: text that is null or has no letter is `und` with score 0. Rows without lang or
doc_id are predicted but never learned from, and a null doc_id is not held out. With no labelled
rows everything is `und`; with one language everything with a letter is that language.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.common import free_name, table

#: Labelled documents of one language that the classifiers are fitted on, at most.
SAMPLE = 400
DIMS, ROUNDS, RIDGE, STEEPNESS = 4096, 150, 1e-4, 4.0
#: Rows whose features a worker holds at a time.
ROWS = 500
UNKNOWN = "und"
#: Share of a language's trigrams that its known ones make up, and where between chance and a sample's share the limit lies.
MASS, BETWEEN = 0.98, 0.25
# Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it pt ro",
    "germanic": "af da de en nb nl nn no sv",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr uz",
    "uralic": "et fi hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
ASCII_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """Is crc32 of doc_id as text divisible by 5?"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def features(text: bytes, dims: int = DIMS) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dims, np.float32)
    gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    bits = dims.bit_length() - 1
    counts = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=dims)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss, by accelerated gradient steps; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y, w = y.astype(np.float32), np.zeros(x.shape[1], np.float32)
    ahead = w
    for i in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - np.float32(0.24) * (np.float32(RIDGE) * ahead - 2 * x.T @ (weight * y * slack))
        w, ahead = step, step + np.float32(i / (i + 3)) * (step - w)
    return w


class Machines:
    """One-versus-one machines over classes; the winner has the most votes, then the largest margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.w = np.array([self._fit(x, labels, self.classes[a], self.classes[b]) for a, b in self.pairs])

    @staticmethod
    def _fit(x: np.ndarray, labels: np.ndarray, a: str, b: str) -> np.ndarray:
        rows = np.flatnonzero((labels == a) | (labels == b))
        return fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number and its least pairwise probability, by row."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, least = np.zeros((n, k)), np.full((n, k), np.inf)
        for (a, b), m in zip(self.pairs, margins.T, strict=True):
            votes[:, a] += (m > 0) + np.tanh(m) * 1e-3
            votes[:, b] += (m <= 0) - np.tanh(m) * 1e-3
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-STEEPNESS * least[np.arange(n), best]))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY_OF.get(x, x) for x in langs])
        self.family = Machines(x, families)
        self.inside = [Machines(x[families == f], langs[families == f]) for f in self.family.classes]
        self.known, self.limits = {}, {}
        for lang in sorted(set(langs)):
            shares = x[langs == lang] ** 2  # of each trigram in its text
            mean = shares.mean(0)
            order = np.argsort(-mean, kind="stable")
            common = order[: int(np.searchsorted(np.cumsum(mean[order]), MASS * mean.sum())) + 1]
            self.known[lang] = np.isin(np.arange(x.shape[1]), common)
            usual, chance = float(np.median(shares[:, common].sum(1))), len(common) / x.shape[1]
            self.limits[lang] = chance + BETWEEN * max(usual - chance, 0)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and known share less its limit, by text."""
        langs, scores, beyond = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -1.0)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t.decode("utf-8", "replace"))]
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            x = np.array([features(texts[i]) for i in part])
            family, sure = self.family.predict(x)
            for f, machines in enumerate(self.inside):
                own = np.flatnonzero(family == f)
                if len(own):
                    best, inner = machines.predict(x[own])
                    for i, b, p in zip(own, best, inner * sure[own], strict=True):
                        lang = str(machines.classes[b])
                        langs[part[i]], scores[part[i]] = lang, p
                        beyond[part[i]] = float((x[i][self.known[lang]] ** 2).sum()) - self.limits[lang]
        return langs, scores, beyond


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """From text and lang of the documents that are not held out."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("text", "doc_id").alias("_h"))
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    chance = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.3 * sample / n + 20 / n))])
    picked = rows.filter(F.pmod("_h", F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30))
    picked = picked.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_r") <= sample)

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).astype(np.float16).tobytes())

    got = picked.select("lang", vector("text").alias("x")).collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return LanguageModel(x, np.array([r["lang"] for r in got]))


def predicted(docs: DataFrame, model: LanguageModel | None, as_name: str = "_lang") -> DataFrame:
    """`docs` with a struct `as_name`: lang_pred, score, and beyond (known share less its limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, beyond: double>")
    def guess(text: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(text), "score": 0.0, "beyond": -1.0})
        langs, scores, beyond = shared.value.predict(list(text))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "beyond": beyond})

    # called deterministic, it would be computed once for a filter and once for what reads it, by two workers in each task
    return docs.withColumn(as_name, guess.asNondeterministic()(F.col("text").cast("binary")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_lang.lang_pred", "_lang.score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; a null lang becomes the predicted one.

    Texts without a letter, and those with too few of the predicted language's trigrams, go.
    """
    found = free_name(docs, "_lang")
    out = predicted(docs, fit(docs.select("doc_id", "text", "lang")), found).filter((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.beyond") >= 0))
    return out.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang_pred"))).select(docs.columns)
