"""Operator 13: collocations from phrase counts by multikey quicksort of suffix pointers.

Texts are cut into pieces, pieces into words. Each word starts a suffix of its piece; what matters of a suffix are the
strings of its first 1 to ``longest`` words, each led by the language and filled up with the empty symbol:

1. Tasks read the texts in batches, number the words of a batch, and combine equal strings of the batch to one weighted
   string. The strings are routed globally by a hash of all their leading words. So a group of equal strings, however common, sends one
   string a batch, and no bucket holds more than its share; a bucket's strings travel as packed arrays with a list of their words.
2. In a bucket, pointers to the strings are sorted by multikey three-way quicksort (Bentley and Sedgewick 1997): a partition is split by its symbol
   at the current depth into less, equal and greater than a pivot, and the equal part goes on at the next depth, to the maximum.
   All partitions of a round are split at once. A partition that weighs less than ``least`` is abandoned at whatever depth it is: all occurrences of
   its strings are in it. What is equal to the maximum depth, or to the empty symbol, is a phrase, and the weight of the
   partition its count.
3. The counted phrases are joined as tables: every cut of a candidate finds the counts of its two parts; they are
   frequent too, since they occur wherever the candidate does. Candidates inside a longer one that is nearly as frequent are dropped. The
   first ``top`` of a language come from the first ``top`` of each of its salted parts.

Products are decimals of 38 digits, so scores are exact for counts up to 10^15.

Defined results: a null language counts as ``und``; a null or empty text, or one of separators, has no words; a repeated row counts again; ties
in the score go by count, then by the phrase's UTF-8 bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matingstats.llm.common import bound_batches, by_value, stored

by_value(__name__)

#: Pieces end at these characters.
STOPS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(STOPS + b"\t", b"." * len(STOPS) + b" ")
_SLICE = 1 << 22


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z only), with ``.`` between pieces, in lists of some MB."""
    data = text.encode().lower().translate(_CLEAN).replace(b".", b" . ")
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > _SLICE:  # after a space within the slice, else after the first one behind it
            cut = data.rfind(b" ", at, at + _SLICE)
            cut = data.find(b" ", at + _SLICE) if cut < 0 else cut
            stop = cut + 1 if cut >= 0 else stop
        yield data[at:stop].split()
        at = stop


def combined(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` (codes below ``size``) and how often each occurs."""
    key, bound = columns[0].astype(np.int64), size
    if size ** len(columns) < 1 << 62:
        for c in columns[1:]:
            key = key * size + c
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in columns[1:]:
            key, c = np.divmod(key, size)
            out.append(c)
        return [key, *out[::-1]], n
    for c in columns[1:]:
        if bound * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key) + 1
        key, bound = key * size + c, bound * size
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return [c[at] for c in columns], n


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64)


class Batch:
    """Numbered words of some texts. ``strings`` are handed out as rows of buckets, at most ``step`` suffixes at a time."""

    def __init__(self, longest: int, buckets: int, step: int = 1 << 21):
        self.longest, self.buckets, self.step = longest, buckets, step
        self.codes: dict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[b"."] = 0  # the end of a piece, and the empty symbol
        self.parts: dict[str, list[np.ndarray]] = {}
        self.chars = 0

    def add(self, lang: str, text: str) -> None:
        own = self.parts.setdefault(lang, [])
        get = self.codes.__getitem__
        for words in words_of(text):
            own.append(np.fromiter(map(get, words), dtype=np.int32, count=len(words)))
        own.append(np.zeros(self.longest, dtype=np.int32))
        self.chars += len(text)

    def rows(self) -> Iterator[tuple[int, str, int, bytes, bytes, bytes]]:
        """(bucket, lang, n, words, codes, weights): n strings as codes of ``longest`` words, one column after the other."""
        vocabulary = list(self.codes)
        size = len(vocabulary)
        mixed = np.array([0, *map(zlib.crc32, vocabulary[1:])], dtype=np.uint64)
        for lang, parts in self.parts.items():
            codes = np.concatenate(parts).astype(np.int64)
            seed = np.uint64(zlib.crc32(lang.encode()))
            for at in range(0, len(codes), self.step):
                ahead = [codes[at + k:at + self.step + k] for k in range(self.longest)]
                whole = np.ones(len(ahead[0]), dtype=bool)
                strings, weights = [], []
                for m in range(1, self.longest + 1):
                    whole = whole[:len(ahead[m - 1])] & (ahead[m - 1] != 0)
                    start = np.flatnonzero(whole)
                    if not len(start):
                        break
                    columns, n = combined([c[start] for c in ahead[:m]], size)
                    own = np.zeros((self.longest, len(n)), dtype=np.int32)
                    for k, column in enumerate(columns):
                        own[k] = column
                    strings.append(own)
                    weights.append(n)
                if strings:
                    yield from self._dealt(lang, seed, np.concatenate(strings, axis=1), np.concatenate(weights), vocabulary, mixed)

    def _dealt(self, lang, seed, strings, weights, vocabulary, mixed):
        h = np.full(strings.shape[1], seed, dtype=np.uint64)
        for column in strings:
            h = (h ^ mixed[column]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        bucket = (h % np.uint64(self.buckets)).astype(np.min_scalar_type(self.buckets))
        order = np.argsort(bucket, kind="stable")
        bucket, strings, weights = bucket[order], strings[:, order], weights[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        here = np.zeros(len(vocabulary), dtype=bool)  # the words of one bucket, then their numbers in it
        number = np.zeros(len(vocabulary), dtype=np.int32)
        for a, z in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
            own = strings[:, a:z]
            here[own] = True
            here[0] = True  # 0 stays the empty symbol
            used = np.flatnonzero(here)
            here[used] = False
            number[used] = np.arange(len(used))
            yield (int(bucket[a]), lang, z - a, b" ".join([vocabulary[k] for k in used[1:].tolist()]), _narrow(number[own]), _narrow(weights[a:z]))


def frequent(strings: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers to ``strings`` (one row per depth, 0 ends a string): a pointer to each distinct string
    that weighs ``least`` or more, and its weight."""
    depths, size = strings.shape
    symbols = np.ascontiguousarray(strings).ravel()
    at = np.arange(size)  # pointers to the symbols at the current depth; a depth further is ``size`` further
    heavy = weights.astype(np.float64)  # exact below 2^53
    part = np.zeros(size, dtype=np.int32)  # partition of each pointer; those of a partition are neighbours
    parts, draw = 1, np.random.default_rng(42)
    if heavy.sum() < least:
        at = at[:0]
    found, counts = [at[:0]], [np.zeros(0, dtype=np.int64)]
    while len(at):
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        some = first + (draw.random((3, parts)) * np.diff(np.append(first, len(at)))).astype(np.int64)
        pivot = np.sort(symbols[at[some]], axis=0)[1]  # the median of three
        last = at[first] >= (depths - 1) * size
        symbol, bar = symbols[at], pivot[part]
        made, rest = 0, []
        for own in (symbol < bar, symbol == bar, symbol > bar):
            equal = len(rest) == 1
            own = np.flatnonzero(own)
            p, ptr, w = part[own], at[own], heavy[own]
            weight = np.bincount(p, weights=w, minlength=parts)
            keep = weight >= least
            if equal:  # strings that are equal to their end are counted
                ends = keep & ((pivot == 0) | last)
                one = np.zeros(parts, dtype=np.int64)
                one[p] = ptr
                found.append(one[ends] % size)
                counts.append(weight[ends].astype(np.int64))
                keep &= ~ends
                ptr = ptr + size
            stay = keep[p]
            number = np.cumsum(keep, dtype=np.int32) + np.int32(made - 1)
            rest.append((ptr[stay], number[p[stay]], w[stay]))
            made += int(keep.sum())
        at, part, heavy = (np.concatenate(x) for x in zip(*rest))
        parts = made
    return np.concatenate(found), np.concatenate(counts)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text",
                  bucket_chars: int = 1 << 22, batch_chars: int = 1 << 24) -> DataFrame:
    """(lang, m, phrase, f): the phrases of 1 to ``longest`` words that occur ``least`` times or more, and for m = 0 numbers of words
    that add up to the language's."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    chars = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // bucket_chars))
    bound_batches(spark)

    names = ["bucket", "lang", "n", "words", "codes", "weights"]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def handed(batch: Batch) -> Iterator[pd.DataFrame]:
            rows, size = [], 0
            for row in batch.rows():
                rows.append(row)
                size += len(row[3]) + len(row[4])
                if size >= 1 << 23:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

        batch = Batch(longest, buckets)
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                batch.add(lang, text)
                if batch.chars >= batch_chars:
                    yield from handed(batch)
                    batch = Batch(longest, buckets)
        yield from handed(batch)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[b""] = 0
        langs: dict[str, int] = {}
        strings, weights = [], []
        for _, lang, n, own, codes, weight in pdf[names].itertuples(index=False, name=None):
            weights.append(_widened(weight, n))
            own = own.split(b" ")
            place = np.fromiter((words[w] for w in own), dtype=np.int32, count=len(own))
            one = np.empty((longest + 1, n), dtype=np.int32)
            one[0] = langs.setdefault(lang, len(langs)) + 1  # 0 is the empty symbol
            one[1:] = np.append(np.int32(0), place)[np.frombuffer(codes, dtype=f"u{len(codes) // (longest * n)}")].reshape(longest, n)
            strings.append(one)
        strings, weights = np.concatenate(strings, axis=1), np.concatenate(weights)
        at, n = frequent(strings, weights, least)
        name, text = list(langs), [w.decode() for w in words]
        single = strings[2] == 0 if longest > 1 else np.ones(len(weights), dtype=bool)
        total = np.bincount(strings[0][single], weights=weights[single], minlength=len(name) + 1)[1:].astype(np.int64).tolist()
        rows = [(name[s[0] - 1], len(s) - 1 - s[1:].count(0), " ".join([text[k] for k in s[1:] if k]), f)
                for s, f in zip(strings[:, at].T.tolist(), n.tolist())]
        rows += [(name[k], 0, None, f) for k, f in enumerate(total)]
        return pd.DataFrame(rows, columns=["lang", "m", "phrase", "f"])

    dealt = texts.mapInPandas(packed, "bucket long, lang string, n long, words binary, codes binary, weights binary")
    dealt = dealt.repartition(min(buckets, 10_000), "bucket")  # tasks grow with the buckets, not with a setting
    return dealt.groupBy("bucket").applyInPandas(counted, "lang string, m int, phrase string, f long")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, salts: int = 16, **how) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count; l, r: the counts of the parts of its weakest cut; n: the language's words; score: floor(10^6 a^2 / (l r)). A phrase inside a
    longer one that has at least ``inside`` per cent of its occurrences is dropped.
    """
    counts = stored(phrase_counts(docs, longest, least, **how), "phrases")
    totals = counts.where("m = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("m > 0").select("lang", F.col("phrase").alias("part"), "f")
    chosen = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = F.expr("transform(sequence(1, m - 1), k -> named_struct('k', k, 'x', array_join(slice(w, 1, k), ' '), 'y', array_join(slice(w, k + 1, m), ' ')))")
    cut = chosen.select("lang", "phrase", "m", "a", F.inline(cuts))
    cut = cut.join(known.select("lang", F.col("part").alias("x"), F.col("f").alias("l")), ["lang", "x"])
    cut = cut.join(known.select("lang", F.col("part").alias("y"), F.col("f").alias("r")), ["lang", "y"])
    score = F.expr("(CAST(1000000 AS decimal(7,0)) * CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    scored = cut.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    shorter = F.expr("flatten(transform(sequence(2, greatest(m - 1, 2)), z -> transform(sequence(1, m - z + 1), i -> array_join(slice(w, i, z), ' '))))")
    longer = chosen.where("m > 2").select("lang", "a", F.explode(shorter).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR 100 * most < {int(inside)} * a"))

    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
