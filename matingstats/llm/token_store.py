"""Operator 8: token-id files with Elias-Fano encoded document boundaries.

Documents are range-partitioned and sorted by id, encoded, and written in blocks of whole documents. A block is one row of
the files: its ids concatenated (little-endian, 2 bytes if the vocabulary allows, else 4), the document ids, and the
boundaries of the documents in the id array as an Elias-Fano sequence: the low bits of every boundary packed, the
high bits as a bit string in which the position of the i-th one tells the i-th high part, and a
sample of the ones' counts for select. That takes about 2 + log2(tokens / documents) bits a document. The
files are Parquet, so that Spark commits them (once, whatever is retried) in any store it can write to.

A block ends once it has ``block_tokens`` ids, so tasks hold a block and a batch at most. Where a shard (one task's blocks) begins
in the whole follows from the totals of the shards: one row a task.

Defined results: a null or empty text is only the end id; null document ids come first; rows with the same id stand in the order of their
keys; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matingstats.llm.common import ROW, batches_of, by_value, maybe_broadcast, release_memory, with_row_key, worker_state

by_value(__name__)

BLOCK = ("shard int, block int, before long, n_docs int, n_tokens long, width int, doc_ids array<{kind}>, ids binary, "
         "low_bits int, low binary, high binary, samples binary")


class EliasFano:
    """A rising sequence of integers in about 2 + log2(last / n) bits each, with select."""

    EVERY = 64  # bytes of the high bits a sample stands for

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        values = values.astype(np.int64)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        high = np.zeros((last >> low_bits) + n + 1, dtype=np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        packed = np.packbits(high, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), packed.tobytes(),
                   ones[::cls.EVERY].astype("<u4").tobytes())

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at the places ``which``."""
        which = np.asarray(which, dtype=np.int64)
        high = np.frombuffer(self.high, dtype=np.uint8)
        samples = np.frombuffer(self.samples, dtype="<u4").astype(np.int64)
        part = np.searchsorted(samples, which, side="right") - 1  # the sampled run of bytes with that one
        out = np.empty(len(which), dtype=np.int64)
        for p in np.unique(part):
            own = part == p
            run = np.unpackbits(high[p * self.EVERY:(p + 1) * self.EVERY], bitorder="little")
            out[own] = np.flatnonzero(run)[which[own] - samples[p]] + p * self.EVERY * 8
        low = np.zeros(len(which), dtype=np.int64)
        if self.low_bits:
            at = which[:, None] * self.low_bits + np.arange(self.low_bits)
            bits = np.frombuffer(self.low, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1
            low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((out - which) << self.low_bits) | low


class LibraryEncoder:
    """Ids of texts by the tokenizers library, which is called once for each word not met yet.

    The library's byte-level splitting cuts before each blank, and around each line feed, that has no other white space
    beside it, and between a letter or digit and the punctuation that ends a chunk. Texts are cut in the same places, and the ids of
    the parts joined. Texts with other white space go to the library whole, and so do all texts if the file describes another splitting.
    """

    #: Bytes of remembered chunks and ids, about, in both tables together.
    REMEMBER = 128 << 20
    #: Punctuation that is cut off the end of a chunk; no apostrophe, which may begin a contraction.
    TAIL = ".,!?;:%*$&|)\"}]"

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        described = json.loads(model)
        splitting = described.get("pre_tokenizer") or {}
        self.cuts = (described.get("normalizer") is None and splitting.get("type") == "ByteLevel" and splitting.get("use_regex", True)
                     and not splitting.get("add_prefix_space", True) and described["model"].get("type") == "BPE")
        self.held = 0
        self.after_blank: dict[str, bytes] = {}  # ids of a chunk that a blank precedes
        self.plain: dict[str, bytes] = {}  # of one that begins a text or a line, and of tails

        # the characters by which byte-level models write bytes: printable ones stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.written = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str], blank: str) -> list[bytes]:
        """Ids of words of letters, which the splitting leaves whole: they go to the library's model directly."""
        model, written = self.tokenizer.model.tokenize, self.written
        return [array("I", [t.id for t in model((blank + w).encode().decode("latin-1").translate(written))]).tobytes() for w in words]

    def _learn(self, chunks: set[str], known: dict[str, bytes], blank: str) -> None:
        """Ids of chunks without white space into ``known``."""
        self._count(chunks)
        whole, words, cut, tails = [], [], [], set()
        for c in chunks:
            if c.isalpha():
                words.append(c)
                continue
            head = c.rstrip(self.TAIL)
            if len(head) < len(c) and head[-1:].isalpha():
                tail = c[len(head):]
                cut.append((c, head, tail))
                tails.add(tail)
            else:
                whole.append(c)
        for h in {h for _, h, _ in cut}.difference(known, chunks):  # a head ends in a letter, so it is never cut itself
            (words if h.isalpha() else whole).append(h)
        known.update(zip(words, self._word_ids(words, blank)))
        known.update(zip(whole, self._ids([blank + c for c in whole] if blank else whole)))
        own = list(tails.difference(self.plain))
        self.plain.update(zip(own, self._ids(own)))
        plain = self.plain
        for c, head, tail in cut:
            known[c] = known[head] + plain[tail]

    def _count(self, chunks) -> None:
        """An entry has about 200 bytes besides its characters and ids."""
        self.held += 200 * len(chunks) + 3 * sum(map(len, chunks))

    def _resolve(self, chunks: set[str], known: dict[str, bytes], blank: str, lines: set[str]) -> set[str]:
        """Learns chunks; returns those with white space that is not a single line feed."""
        simple, folded, odd = {c for c in chunks if c.isalpha()}, [], set()
        for c in chunks - simple:
            words = c.split()
            if len(words) == 1 and len(words[0]) == len(c):
                simple.add(c)
            elif words and "\n".join(words) == c:
                folded.append((c, words))
                lines.update(words[1:])
                if words[0] not in known:
                    simple.add(words[0])
            else:
                odd.add(c)
        self._learn(simple, known, blank)
        self._learn(lines.difference(self.plain), self.plain, "")
        self._count([c for c, _ in folded])
        feed = self.feed
        for c, words in folded:
            known[c] = feed.join([known[words[0]], *map(self.plain.__getitem__, words[1:])])
        return odd

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return self._ids([t or "" for t in texts])
        if self.held > self.REMEMBER:
            self.after_blank.clear()
            self.plain.clear()
            self.held = 0
        (self.feed,) = self._ids(["\n"])
        whole = [k for k, t in enumerate(texts) if t and any(x in t for x in self.special)]
        skip = set(whole)
        firsts, rests, new, begin = [], [], set(), set()
        for k, t in enumerate(texts):
            first, *rest = (t or "").split(" ") if k not in skip else [""]
            firsts.append(first)
            rests.append(rest)
            new.update(rest)
            begin.add(first)
        odd_rest = self._resolve(new.difference(self.after_blank), self.after_blank, " ", set())
        odd_first = self._resolve(begin.difference(self.plain), self.plain, "", set())
        if odd_rest or odd_first:
            whole += [k for k, (f, r) in enumerate(zip(firsts, rests)) if k not in skip and (f in odd_first or not odd_rest.isdisjoint(r))]
            skip = set(whole)
        get = self.after_blank.__getitem__
        out = [b"" if k in skip else self.plain[f] + b"".join(map(get, r)) for k, (f, r) in enumerate(zip(firsts, rests))]
        for k, ids in zip(whole, self._ids([texts[k] or "" for k in whole])):
            out[k] = ids
        return out


def write_tokens(docs: DataFrame, path: str, model_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 shards: int | None = None, shard_bytes: int = 32 << 20, block_tokens: int = 1 << 20, most_shards: int = 8192) -> None:
    """Writes the ids of all documents in ascending order of their ids to ``path``. Text ids are kept as texts, whole numbers as long.

    At most ``most_shards`` ranges, however much text there is: memory is that of a block and a batch, whatever a shard holds.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:  # bounded by the vocabulary; executors need not have the file
        model = f.read()
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    kind = "bigint" if whole else "string"
    layout = BLOCK.format(kind=kind)
    keyed = with_row_key(docs, id_col, text_col).select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"), ROW)
    if not shards:
        total = keyed.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        shards = min(most_shards, max(1, -(-total // shard_bytes)))
    sorted_ = keyed.repartitionByRange(shards, F.col("id").asc_nulls_first(), ROW).sortWithinPartitions(F.col("id").asc_nulls_first(), ROW)
    names = [part.split()[0] for part in layout.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        shard, block, before, width = TaskContext.get().partitionId(), 0, 0, 4
        encoder, ids, coded, total = None, [], [], 0

        def done() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
            flat = np.frombuffer(b"".join(coded), dtype="<u4")
            ef = EliasFano.of(ends)
            row = [shard, block, before, len(ids), int(ends[-1]), width, ids, flat.astype("<u2" if width == 2 else "<u4").tobytes(),
                   ef.low_bits, ef.low, ef.high, ef.samples]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64() if whole else pa.string()), pa.binary(),
                     pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        end = np.array([end_id], dtype="<u4").tobytes()
        try:
            for batch in batches:
                if encoder is None:  # one for all tasks of the worker
                    encoder = worker_state("token encoder", hash(model), lambda: LibraryEncoder(model))
                    width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for i, c in zip(part.column("id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                        ids.append(i)
                        coded.append(c + end)
                        total += len(c) // 4 + 1
                        if total >= block_tokens:
                            yield done()
                            before, block, ids, coded, total = before + total, block + 1, [], [], 0
            if ids:
                yield done()
        finally:  # the worker goes on to other tasks
            ids = coded = batch = part = None
            release_memory()

    with batches_of(spark, 1000, 8 << 20):
        sorted_.mapInArrow(run, layout).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a task of the writer
    bases = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    placed = blocks.join(maybe_broadcast(bases, 100_000), "shard").withColumn("begin", F.col("base") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(n)[at].as_py() for n in ("begin", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "samples")}
                ends = EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["samples"]).select(np.arange(r["n_docs"] + 1))
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], id_type), pa.array(r["begin"] + ends[:-1]), pa.array(np.diff(ends)),
                                                  pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    cols = ["begin", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "samples"]
    return placed.select(*cols).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
