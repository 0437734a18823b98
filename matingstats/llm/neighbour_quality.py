"""Operator 12: quality by votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of terms: its words, the shapes of its words (letters, digits and other characters, runs shortened), and a mark for the
share of words that repeat the one before. Terms are hashed into ``TERMS`` columns, weighted by log frequency and rarity, and each document's
words and marks are brought to equal length. A truncated singular value decomposition of the labelled documents (randomised range finder; Halko
et al. 2011) gives the latent space of ``dims`` axes. The labelled documents' vectors are broadcast; the cosines of every document
with all of them are computed exactly, as blocked matrix products. Its ``nearest`` neighbours, and all others as near as the last of them,
vote with a power of their similarity.

The model is fitted on at most ``sample`` labelled documents (the first by hash of the id), equal texts once; the bound holds for what comes to the driver and
for the broadcast: ``sample`` sparse vectors, and (TERMS + sample) * dims numbers. Scoring covers every whole text, in the partitions in which it
lies, without a shuffle.

Defined results: a null or empty text, or one of white space, resembles nothing and gets the share of good labels as its score; without usable
labels every score is 0.5; a document labelled more than once is good if any label says so; null ids or labels are not learnt from; repeated
rows are scored one by one; an empty table gives an empty result; all other columns are kept, but ``score``, which the result replaces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import bound_batches, by_value, quoted, stored

by_value(__name__)

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8_000
#: Columns of hashed terms: words first, then shapes and marks.
WORDS, SHAPES = 3_072, 1_024
TERMS = WORDS + SHAPES
#: Columns of the shapes' part that tell the share of words that repeat the one before.
MARKS = 11

_RUN = re.compile(rb"(.)\1+", re.DOTALL)
#: Letters by case, digits, bytes of other scripts; all else stands for itself.
_KIND = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 else 48 if 48 <= c < 58 else 117 if c >= 128 else c for c in range(256))


@dataclass
class Model:
    """rarity: weight of each term; axes: terms to latent space; vectors: unit vectors of the labelled documents; good: their labels."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    nearest: int
    power: float


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(id_col.cast("string")) % 5 == 0


class _Places(dict):
    """Columns of a word and of its shape, as one number."""

    def __missing__(self, word: bytes) -> int:
        plain = word.isalpha() and word.islower()
        shape = b"a" if plain else _RUN.sub(rb"\1", word.translate(_KIND))[:12]
        self[word] = got = zlib.crc32(word.lower()) % WORDS * TERMS + WORDS + zlib.crc32(shape, 1) % (SHAPES - MARKS)
        return got


class Terms:
    """Hashed terms of texts, with a bounded memory of words seen."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.places = _Places()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and how often their terms occur."""
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0)
        if len(self.places) > self.most:
            self.places.clear()
        seen = Counter(words)
        both = np.fromiter(map(self.places.__getitem__, seen), dtype=np.int64, count=len(seen))
        n = np.fromiter(seen.values(), dtype=np.float64, count=len(seen))
        found = np.bincount(both // TERMS, weights=n, minlength=TERMS) + np.bincount(both % TERMS, weights=n, minlength=TERMS)
        again = sum(map(bytes.__eq__, words, words[1:]))
        found[TERMS - MARKS + (MARKS - 1) * again // len(words)] = len(words)  # the mark of the share of repeated words
        at = np.flatnonzero(found)
        return at.astype(np.int32), found[at]


def weighted(rows: list[tuple[np.ndarray, np.ndarray]], rarity: np.ndarray) -> np.ndarray:
    """Term vectors of documents: log counts times rarity, words and marks each of length one."""
    x = np.zeros((len(rows), TERMS))
    for k, (at, n) in enumerate(rows):
        x[k, at] = np.log1p(n)
    x *= rarity
    for a, z in ((0, WORDS), (WORDS, TERMS)):
        size = np.sqrt((x[:, a:z] ** 2).sum(axis=1, keepdims=True))
        x[:, a:z] /= np.where(size > 0, size, 1)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, dims: int, nearest: int, power: float, step: int = 1000) -> Model:
    """The latent space of the documents ``rows`` and their vectors in it."""
    n = len(rows)
    df = np.zeros(TERMS)
    for at, _ in rows:
        df[at] += 1
    rarity = np.log((n + 1) / (df + 1)) + 0.1
    blocks = [(k, rows[k:k + step]) for k in range(0, n, step)]  # dense for a block at a time
    q = np.linalg.qr(np.random.default_rng(42).standard_normal((TERMS, dims + 16)))[0]
    for _ in range(4):
        y = np.zeros_like(q)
        for _, block in blocks:
            x = weighted(block, rarity)
            y += x.T @ (x @ q)
        q = np.linalg.qr(y)[0]
    gram = np.zeros((q.shape[1], q.shape[1]))
    latent = np.zeros((n, q.shape[1]))
    for k, block in blocks:
        latent[k:k + len(block)] = weighted(block, rarity) @ q
    gram = latent.T @ latent
    turn = np.linalg.eigh(gram)[1][:, ::-1][:, :dims]
    return Model(rarity, q @ turn, _unit(latent @ turn), good.astype(np.float64), nearest, power)


def votes(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of documents: cosines with all labelled vectors, then the nearest ones' votes."""
    if not len(model.good):
        return np.full(len(rows), 0.5)
    near = np.round(_unit(weighted(rows, model.rarity) @ model.axes) @ model.vectors.T, 9)  # rounded: equal vectors tie in whatever block
    k = min(model.nearest, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    weight = np.where(near >= last, np.maximum(near, 0.0) ** model.power, 0.0)
    prior = 1e-3
    return np.clip((weight @ model.good + prior * model.good.mean()) / (weight.sum(axis=1) + prior), 0.0, 1.0)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, good) of at most ``sample`` labelled documents, equal texts once; stored."""
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
           .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("good"))
           .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.join(F.broadcast(ids), "id")  # at most ``sample`` rows
    return stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("good").alias("good"), F.min("id").alias("id")).drop("h"), "sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = 48, nearest: int = 9, power: float = 4.0,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model learnt from ``labels`` (id, label) of documents that are not held out."""
    rows = _sampled(docs, labels, sample, id_col, text_col, label_col)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for pdf in batches:
            each = [terms.counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"].astype(str), "good": (pdf["good"] > 0).astype("int32"),
                                "at": [a.astype(np.int16).tobytes() for a, _ in each], "n": [n.astype(np.float32).tobytes() for _, n in each]})

    bound_batches(docs.sparkSession)
    got = rows.mapInPandas(counted, "id string, good int, at binary, n binary").collect()  # at most ``sample`` sparse vectors
    got.sort(key=lambda r: r["id"])
    vectors = [(np.frombuffer(r["at"], dtype=np.int16).astype(np.int32), np.frombuffer(r["n"], dtype=np.float32).astype(np.float64)) for r in got]
    if not vectors:
        return Model(np.zeros(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0)), np.zeros(0), nearest, power)
    return learn(vectors, np.array([r["good"] for r in got]), min(dims, TERMS), nearest, power)


def score(docs: DataFrame, model: Model, text_col: str = "text", block: int = 256) -> DataFrame:
    """``docs`` with the column score instead of the text."""
    bound_batches(docs.sparkSession)
    # (TERMS + sample) * dims numbers at most; a broadcast is pickled by reference, so plain values only
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    @F.pandas_udf("double")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, own = Terms(), Model(*shared.value)
        for texts in batches:
            out = [np.zeros(0)]
            for k in range(0, len(texts), block):
                out.append(votes(own, [terms.counts(t) for t in texts.iloc[k:k + block]]))
            yield pd.Series(np.concatenate(out))

    kept = [quoted(c) for c in docs.columns if c not in (text_col, "score")]
    return docs.select(*kept, voted(quoted(text_col)).alias("score"))
