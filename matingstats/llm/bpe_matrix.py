"""Operator 9: byte-level BPE encoding and decoding with padded matrices.

Texts are cut by the split pattern. The distinct pieces of a batch that the task has not met yet are put into
matrices by length (a row per piece, padded). In each round the ranks of all neighbouring pairs
of all rows are looked up in a hash table of pairs; every row merges its leftmost pair of
minimum rank, the tail of the row moves up, and rows without a pair leave the matrix. Pieces over ``WIDEST``
bytes, which would make a matrix of one row and as many rounds as bytes, take the same merges from a heap.

Splitting is local: a text is first cut before each blank, and as long as no cut touches other
white space these chunks are split by the pattern on their own; the ids of a chunk are remembered
in the task (up to ``REMEMBER`` chunks, then the memory starts anew). Other texts are split whole.

Decoding gathers the bytes of many ids at once from one table.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded one by one; an
empty table gives an empty result; all other columns are kept by ``encode`` and ``decode``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matingstats.llm.common import bound_batches, by_value

by_value(__name__)

WIDEST = 256
REMEMBER = 500_000
_NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int64)
        keys, slots = a << 32 | b, self._slots(a << 32 | b)
        left = np.arange(len(keys))
        while len(left):  # each free slot takes one of the keys that want it, the others move on
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            mine = self.keys[slots[left]] == keys[left]
            self.values[slots[left[mine]]] = r[left[mine]]
            left = left[~mine]
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair, which is its rank; ``_NONE`` if it is no token. Ids below 0 are padding."""
        keys = (left << 32 | right).ravel()
        out = np.full(len(keys), _NONE, dtype=np.int64)
        todo = np.flatnonzero((right >= 0).ravel())
        slots = self._slots(keys[todo])
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            todo, slots = todo[on], (slots[on] + 1) & self.mask
        return out.reshape(left.shape)


class Encoder:
    """Ids of texts by ranks and a split pattern; remembers chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte < 0).any():
            raise ValueError("a byte-level vocabulary has a rank for each byte")
        self.known: dict[str, bytes] = {}

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a padded matrix after all merges."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        while len(rows):
            if ids.shape[1] < 2:
                best = np.full(len(rows), _NONE)
            else:
                ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
                at = ranks.argmin(axis=1)  # the leftmost of equal ones
                best = ranks[np.arange(len(rows)), at]
            done = best >= _NONE
            for r, row in zip(rows[done], ids[done]):
                out[r] = row[row >= 0]
            rows, ids = rows[~done], ids[~done]
            if not len(rows):
                break
            at, best = at[~done], best[~done]
            ids[np.arange(len(rows)), at] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)  # what is right of the pair moves up
        return out

    def merge_long(self, ids: list[int]) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place)."""
        right, left = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        piece = [bytes([b]) for b in ids]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < len(ids):
                rank = self.ranks.get(piece[i] + piece[right[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(piece[i]), len(piece[right[i]])))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, n, m = heapq.heappop(heap)
            if piece[i] is None or len(piece[i]) != n or right[i] >= len(ids) or len(piece[right[i]]) != m:
                continue  # one of the pair has been merged since
            j = right[i]
            piece[i], piece[j], right[i] = piece[i] + piece[j], None, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            offer(i)
            offer(left[i])
        return np.array([self.ranks[p] for p in piece if p is not None], dtype=np.int64)

    def encode_pieces(self, pieces: list[bytes], rows: int = 1 << 14) -> list[np.ndarray]:
        """Ids of each piece (not empty)."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > WIDEST:
                out[k] = self.merge_long(list(p))
            else:  # widths 1, 2, 3, 4, 6, 8, 12, ...
                top = 1 << max(0, (len(p) - 1).bit_length() - 1)
                width = len(p) if len(p) <= 4 else top + top // 2 if len(p) <= top + top // 2 else 2 * top
                by_length.setdefault(width, []).append(k)
        for width, own in by_length.items():
            step = max(64, rows * 8 // width)
            for at in range(0, len(own), step):
                part = own[at:at + step]
                flat = np.frombuffer(b"".join(pieces[k] for k in part), dtype=np.uint8)
                lengths = np.array([len(pieces[k]) for k in part])
                ids = np.full((len(part), width), -1, dtype=np.int64)
                ids[np.arange(width) < lengths[:, None]] = self.byte[flat]
                for k, x in zip(part, self.merge_rows(ids)):
                    out[k] = x
        return out

    def _learn(self, chunks: list[str]) -> None:
        split = [self.pattern.findall(c) for c in chunks]
        pieces = list({p for s in split for p in s})
        ids = dict(zip(pieces, (x.astype("<u4").tobytes() for x in self.encode_pieces([p.encode() for p in pieces]))))
        for c, s in zip(chunks, split):
            self.known[c] = b"".join([ids[p] for p in s])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        cut = []
        for t in texts:
            chunks = (t or "").split(" ")
            if len(chunks) > 1:
                chunks[1:] = [" " + c for c in chunks[1:]]
            cut.append(chunks)
        new = set().union(*cut).difference(self.known)
        odd = {c for c in new if not c.strip() or c[-1].isspace() or (c[1:2] if c[0] == " " else c[:1]).isspace()}
        # a cut beside other white space is not one of the pattern's: these texts are split whole
        whole = {}
        if odd:
            whole = {k: (texts[k] or "") for k, chunks in enumerate(cut) if not odd.isdisjoint(chunks)}
            new -= odd
        self._learn(list(new))
        get = self.known.__getitem__
        out = [b"" if k in whole else b"".join(map(get, chunks)) for k, chunks in enumerate(cut)]
        for k, t in whole.items():
            pieces = self.pattern.findall(t)
            distinct = list(set(pieces))
            ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.encode_pieces([p.encode() for p in distinct]))))
            out[k] = b"".join([ids[p] for p in pieces])
        return out


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``which`` of ``table`` (bytes, cut at ``starts``) in a row, and where each begins there."""
    n = lengths[which]
    begin = np.concatenate([[0], np.cumsum(n)])
    return table[np.arange(begin[-1]) + np.repeat(starts[which] - begin[:-1], n)], begin


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` values of a string or list column (at least a row each)."""
    values = batch.column(column)
    sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_list(values.type) else np.int32,
                                  count=len(values) + values.offset + 1)[values.offset:]) if len(values) else np.zeros(0)
    begin, total = 0, 0
    for k, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield batch.slice(begin, k + 1 - begin)
            begin, total = k + 1, 0
    if begin < len(values):
        yield batch.slice(begin)


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {r: t for t, r in ranks.items()}
        tokens = [by_id.get(k, b"") for k in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> list[bytes]:
        """Bytes of each text; its ids are ``ids`` from one of ``ends`` to the next."""
        data, begins = [], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(ids), step):
            part, begin = gather(self.table, self.starts, self.lengths, ids[at:at + step])
            data.append(part.tobytes())
            begins.append(begin[1:] + begins[-1][-1])
        whole, at = b"".join(data), np.concatenate(begins)[ends]
        return [whole[a:b] for a, b in zip(at[:-1], at[1:])]


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...: names with dots cannot be handed to Arrow functions."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Bytes of text, or ids, that a task works on at a time.
PART = 1 << 19


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text_col`` as an array column ``out_col`` in place of the text.

    ``decoded_col``: a further column of the bytes that these ids decode to, made in the same task. Columns called like the results are
    replaced; all others are kept, whatever they are called.
    """
    with open(ranks_path, "rb") as f:  # bounded by the vocabulary; executors need not have the file
        raw = f.read()
    bound_batches(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name not in (text_col, out_col, decoded_col)]
    schema = T.StructType([*others, T.StructField(out_col, T.ArrayType(T.IntegerType(), False))]
                          + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else []))
    text, kept = f"c{docs.columns.index(text_col)}", [f"c{docs.columns.index(f.name)}" for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decoder = None
        for batch in batches:
            if encoder is None:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}
                encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)
            for part in _slices(batch, text, PART):
                coded = encoder.encode(part.column(text).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), dtype="<i4")
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded_col:
                    made.append(pa.array(decoder.decode(flat, ends), pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, schema.fieldNames())

    return _numbered(docs).mapInArrow(run, schema)


def decode(coded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the bytes that the ids stand for as a binary column ``out_col``, which replaces one of that name."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    bound_batches(coded.sparkSession)
    others = [f for f in coded.schema.fields if f.name != out_col]
    schema = T.StructType([*others, T.StructField(out_col, T.BinaryType())])
    coded_ids, kept = f"c{coded.columns.index(ids_col)}", [f"c{coded.columns.index(f.name)}" for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())})
        for batch in batches:
            for part in _slices(batch, coded_ids, PART):
                ids = part.column(coded_ids)
                ends = ids.offsets.to_numpy().astype(np.int64)
                made = pa.array(decoder.decode(ids.flatten().to_numpy(zero_copy_only=False), ends - ends[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [made], schema.fieldNames())

    return _numbered(coded).mapInArrow(run, schema)
