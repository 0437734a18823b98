"""Operator 3: toxicity by multiple-instance learning.

Only documents are labelled, sentences are not. A sentence's probability is a logistic function of the evidence words in
it; a document's is the noisy-or of its sentences and a leak: one minus the product of the chances that each sentence, and the
leak, leaves it clean. The weights are fitted to the document labels; afterwards the sentence probabilities tell which
sentences offend.

Evidence are words and beginnings of words (three to six characters). They are chosen by how much more
often they occur in toxic documents, on a bounded sample of labelled documents (``sample``, the first by hash);
equal texts count once. Only the chosen features of the sample's sentences come to the driver, where the
weights are fitted. Scoring covers every whole text, in the partitions in which it lies.

Defined results: a null or empty text, or one without evidence, gets the leak as its score and no offending
sentences; with no usable labels the model is empty and every score is 0; a document labelled more than once is toxic if any label
says so; null ids or labels are not learnt from; repeated rows are scored one by one; an empty table
gives an empty result; all other columns are kept, but ``score`` and ``offending``, which the results replace.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matingstats.llm.common import bound_batches, by_value, quoted, stored

by_value(__name__)

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Features of the model, at most.
FEATURES = 5_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """weights: of features (a word, or a beginning followed by ``*``); bias: of a sentence with evidence; leak: of a document."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:k] + "*" for k in range(3, min(6, len(word) - 1) + 1))]


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(id_col.cast("string")) % 3 == 1


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents, equal texts once; stored."""
    ids = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
           .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.join(F.broadcast(ids), "id")  # at most ``sample`` rows
    return stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h"), "sample")


def _choose(rows: DataFrame, most: int, least_docs: int) -> dict[str, float]:
    """Features and their log ratio of document shares, toxic to clean, plus the numbers of documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = Counter(), Counter()
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                words = {w for t in set(text.lower().split()) for w in _WORD.findall(t)}
                each[int(toxic > 0)].update({f for w in words for f in features(w)})
        seen = list(each[0].keys() | each[1].keys())
        yield pd.DataFrame({"f": pd.Series(seen, dtype=object), "clean": [each[0][f] for f in seen], "bad": [each[1][f] for f in seen]}).astype({"clean": "int64", "bad": "int64"})

    n = rows.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"), F.count("*").alias("all")).first()
    if not n["bad"] or n["bad"] == n["all"]:
        return {}
    ratio = F.log((F.col("bad") + 0.5) / (n["bad"] + 1)) - F.log((F.col("clean") + 0.5) / (n["all"] - n["bad"] + 1))
    chosen = (rows.mapInPandas(count, "f string, clean long, bad long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
              .where(F.col("bad") >= least_docs).withColumn("ratio", ratio).where(F.col("ratio") > math.log(5))
              .orderBy((F.col("ratio") * F.sqrt("bad")).desc(), "f").limit(most).collect())  # at most ``most`` rows
    return {r["f"]: r["ratio"] for r in chosen}


def _bags(rows: DataFrame, chosen: list[str]) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Labels and, per document, the chosen features of each sentence that has any."""
    place = {f: k for k, f in enumerate(chosen)}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                each = [sorted({place[f] for w in _WORD.findall(s) for f in features(w) if f in place}) for s in _SENTENCE.findall(text.lower())]
                found.append([x for x in each if x])
            yield pd.DataFrame({"toxic": (pdf["toxic"] > 0).astype("int32"), "bags": found})

    got = rows.mapInPandas(bags, "toxic int, bags array<array<int>>").collect()  # at most ``sample`` rows of chosen features
    return np.array([r["toxic"] for r in got], dtype=float), [r["bags"] for r in got]


def _noisy_or(labels: np.ndarray, bags: list, size: int, start: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the likelihood of the labels, by gradient steps with momentum (Adam)."""
    doc = np.array([d for d, each in enumerate(bags) for _ in each], dtype=np.int64)
    rows = np.array([s for s, own in enumerate(x for each in bags for x in each) for _ in own], dtype=np.int64)
    cols = np.array([c for each in bags for own in each for c in own], dtype=np.int64)
    # parameters: weights, bias, logit of the leak
    p = np.concatenate([start, [-2.0, math.log(0.02 / 0.98)]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights=p[cols], minlength=len(doc)) + p[-2]
        on = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-p[-1]))
        clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(labels)) - np.logaddexp(0, p[-1])  # log of the chance to be clean
        pull = np.where(labels > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), 1.0)  # d loss / d(-clean)
        g_z = pull[doc] * on
        g = np.concatenate([np.bincount(cols, weights=g_z[rows], minlength=size), [g_z.sum(), (pull * leak).sum()]])
        g[:size] += ridge * p[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], float(p[-2]), float(1 / (1 + math.exp(-p[-1])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, least_docs: int = 5, ridge: float = 0.05,
        rounds: int = 400, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model learnt from ``labels`` (id, toxic) of documents that are not held out."""
    rows = _sampled(docs, labels, sample, id_col, text_col)
    chosen = _choose(rows, most, least_docs)
    if not chosen:
        return Model()
    names = list(chosen)
    toxic, bags = _bags(rows, names)
    weights, bias, leak = _noisy_or(toxic, bags, len(names), np.array([chosen[f] for f in names]) / 2, ridge, rounds)
    return Model({f: float(w) for f, w in zip(names, weights)}, bias, leak)


class Scorer:
    """Scores texts. An automaton of all features finds the few texts, and sentences, that have any."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.found = None
        if model.weights:
            self.found = ahocorasick.Automaton()
            kinds: dict[str, int] = {}  # 1: a word, 2: a beginning, 3: both
            for f in model.weights:
                key = f.removesuffix("*")
                kinds[key] = kinds.get(key, 0) | (2 if f.endswith("*") else 1)
            for key, kind in kinds.items():
                self.found.add_word(key, (len(key), kind))
            self.found.make_automaton()

    def evidence(self, low: str) -> bool:
        """Whether any word of a lower-cased text has a feature of the model."""
        if self.found is None:
            return False
        word = _WORD.match
        for end, (n, kind) in self.found.iter(low):
            if (end < n or not word(low, end - n)) and (kind & 2 and word(low, end + 1) or kind & 1 and not word(low, end + 1)):
                return True
        return False

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Score, and the sentences (start, end in characters, score) that are more likely toxic than not."""
        clean, found = 1 - self.model.leak, []
        if text and self.evidence(text.lower()):
            for s in _SENTENCE.finditer(text):
                low = s[0].lower()
                own = {f for w in _WORD.findall(low) for f in features(w) if f in self.model.weights} if self.evidence(low) else None
                if own:
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.bias + sum(self.model.weights[f] for f in sorted(own))))))
                    clean *= 1 - p
                    if p > 0.5:
                        found.append({"start": s.start(), "end": s.end(), "score": p})
        return min(1.0, max(0.0, 1 - clean)), found


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score and offending (start, end, score); without the text unless ``keep_text``."""
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text_col) and f.name not in ("score", "offending")]
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(place))]))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            got = [scorer.score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in got], "offending": [o for _, o in got]})

    kept = [quoted(f.name) for f in kept]
    # the result's name is nobody's: columns keep theirs
    out = docs.select(F.struct(*kept).alias("kept") if kept else F.lit(None).alias("kept"), scored(quoted(text_col)).alias("found"))
    return out.select(*(["kept.*"] if kept else []), "found.score", "found.offending")
