"""Operator 2: removal of repeated strings, wherever they are, by a Burrows-Wheeler transform.

Every byte covered by a string of ``least`` bytes that starts anywhere else as well is removed. The search is distributed
without giving up any repeat:

1. Each window of ``least`` bytes is named by the smallest hash of the ``GRAM``-byte strings in it. Equal windows have equal
   names, in whatever documents they are. Neighbouring windows with one name form a segment.
2. Names that occur once are done, unless the string behind the name occurs twice in the segment (which may then repeat within itself). Segments of one name with the
   same content (64-bit BLAKE2b) repeat as a whole, without any further search. What remains are names whose segments differ:
   the edges of repeated passages and the surroundings of edits. One segment of each content is examined.
3. The examined segments are dealt by name into shards of about ``shard_bytes``. In each shard their concatenation is suffix-sorted
   up to ``least`` bytes and its Burrows-Wheeler transform, over words of ``WORD`` bytes, searched breadth first: all intervals of one
   length are extended backwards by a word at once; intervals of one suffix end there. Intervals alive at length l are
   the suffixes with a common prefix of at least l, for rising l, so at ``least`` the rest are the repeats, and the expansion
   stops. No extension crosses the start of a segment. (Words, not bytes: 25 steps instead of 200, same intervals.)
4. Names with more than ``hot_bytes`` of differing segments would make one shard too large; their windows are
   compared by a 128-bit hash, counted with pre-aggregation, over all tasks.

Names and segments are counted and joined by Spark with pre-aggregation, a common passage included. The texts are joined by row key twice, to
cut the examined segments and to remove the spans; both lists grow with the input and are not broadcast.

Defined results: a null text counts as empty; strings shorter than ``least`` are never removed; a repeated row repeats
all of its strings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import ROW, bound_batches, by_value, stored, with_row_key

by_value(__name__)

LEAST = 200
#: Bytes of the strings that name windows of 128 bytes and more; shorter windows have shorter ones.
GRAM = 64
#: Bytes by which intervals are extended at a time: the symbols of the transform are words.
WORD = 8
#: Windows of a segment at most; a longer run is cut.
LONGEST = 4096


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes, by doubling."""
    h = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)[data]
    factor, step = 0x9E3779B97F4A7C15 | 1, 1
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    n, have = len(h) - width + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have:width - have + n]) if have < width else h[:n]


def segments(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(which text, start, windows, name, content, again) of the segments of all texts; texts have ``least`` bytes at least.

    ``again``: the string that names the segment occurs in it more than once.
    """
    gram = min(GRAM, 1 << max(0, (least // 2).bit_length() - 1))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    grams, width = _gram_hashes(data, gram), least - gram + 1
    name = _least_of(grams, width)
    new = np.ones(len(name), dtype=bool)
    new[1:] = name[1:] != name[:-1]
    new[begins] = True
    for e in ends[:-1]:  # windows across two texts
        new[e - least + 1:e] = False
    start = np.flatnonzero(new)
    of = np.searchsorted(begins, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], len(name)), ends[of] - least + 1)
    parts = -(-(stop - start) // LONGEST)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop, of = np.repeat(start, parts) + nth * LONGEST, np.repeat(stop, parts), np.repeat(of, parts)
        stop = np.minimum(stop, start + LONGEST)
    whole = memoryview(data)
    content = b"".join([hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), (stop + least - 1).tolist())])
    # positions that name some window: those whose hash is the largest of the names of the windows around them
    around = np.concatenate([np.zeros(width - 1, dtype=np.uint64), name, np.zeros(width - 1, dtype=np.uint64)])
    naming = np.flatnonzero(grams == ~_least_of(~around, width))
    low, high = np.searchsorted(naming, start), np.searchsorted(naming, stop + width - 1)
    each = np.repeat(np.arange(len(start)), high - low)
    inside = naming[np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]]
    times = np.bincount(each, weights=grams[inside] == name[start][each], minlength=len(start))
    return of, start - begins[of], stop - start, name[start].view(np.int64), np.frombuffer(content, dtype=np.int64), times > 1


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` sorted by the ``depth`` bytes (or more) that follow, and the word of ``WORD`` bytes at each position."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(WORD, dtype=np.uint8)]).astype(np.uint64)
    words = padded[:n].copy()
    for k in range(1, WORD):
        words = words << np.uint64(8) | padded[k:n + k]
    key, have = words, WORD
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if have >= depth or rank[order[-1]] == n - 1:
            return order, words
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - have, 0)] = rank[have:] + 1
        key, have = rank * (n + 2) + after, 2 * have


def repeats(data: np.ndarray, is_first: np.ndarray, least: int) -> np.ndarray:
    """Positions at which a string of ``least`` bytes starts that starts at another position too.

    Strings lie within the runs that begin where ``is_first`` is true.
    """
    n = len(data)
    order, words = suffix_order(data, least)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    starts = np.flatnonzero(is_first)
    offset = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    room = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n)
    # the transform as a map: from a suffix to the one that starts a word earlier, by their places in the order
    back = np.full(n, -1, dtype=np.int64)
    back[WORD:] = place[:-WORD] if n > WORD else -1
    back[offset < WORD] = -1
    back, words = back[order], words[order]
    length = least % WORD or WORD
    at = np.flatnonzero(room[order] >= length)  # suffixes that have a string of that length
    group = np.zeros(len(at), dtype=np.int64)
    symbol = words >> np.uint64(8 * (WORD - length))
    owner = np.full(n, -1, dtype=np.int64)
    while True:
        edge = np.ones(len(at), dtype=bool)  # a new interval: another one before, or another symbol
        own = symbol[at]
        edge[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        several = np.flatnonzero(~(edge & np.append(edge[1:], True)))
        at, group = at[several], np.cumsum(edge)[several]
        if length >= least or not len(at):
            return np.sort(order[at])
        to = back[at]  # extend each interval backwards
        ok = np.flatnonzero(to >= 0)
        to = to[ok]
        owner[to] = group[ok]
        at = np.flatnonzero(owner >= 0) if len(to) > n // 12 else np.sort(to)
        group = owner[at]
        owner[to] = -1
        symbol, length = words, length + WORD


def _cut_texts(rows: DataFrame, wanted: DataFrame, out: str, make) -> DataFrame:
    """Joins the lists ``wanted`` (ROW, row of the text; list) to the texts and maps (text bytes, list) by ``make``."""
    lists = wanted.groupBy(ROW).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != ROW])).alias("list"))

    names = [part.split()[0] for part in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for row, text, items in zip(pdf[ROW], pdf["text"], pdf["list"]):
                made += make(row, text.encode(), items)
                if len(made) >= 50_000:
                    yield pd.DataFrame(made, columns=names)
                    made = []
            yield pd.DataFrame(made, columns=names)

    return rows.join(lists, ROW).select(ROW, "text", "list").mapInPandas(run, out)


def _examined(rows: DataFrame, chosen: DataFrame, least: int, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """(ROW, s, e): strings of the segments ``chosen`` (name, ROW, pos, windows, alone) that repeat, for those that are alone."""
    sizes = chosen.groupBy("name").agg(F.sum(F.col("windows") + least - 1).alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.max("bytes"), F.lit(0)).alias("m")).first()
    shards = max(1, -(-int(total["b"]) // shard_bytes))
    cold = chosen.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    hot = None
    if total["m"] > hot_bytes:
        large = sizes.where(F.col("bytes") > hot_bytes).select("name")  # each stands for hot_bytes: total / hot_bytes at most
        hot, cold = cold.join(F.broadcast(large), "name", "left_semi"), cold.join(F.broadcast(large), "name", "left_anti")

    def slices(row: int, data: bytes, items) -> list[tuple]:
        return [(x["shard"], row, x["pos"], x["alone"], data[x["pos"]:x["pos"] + x["windows"] + least - 1]) for x in items]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf["data"].tolist()
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - [len(p) for p in parts]
        first = np.zeros(ends[-1], dtype=bool)
        first[begins] = True
        found = repeats(np.frombuffer(b"".join(parts), dtype=np.uint8), first, least)
        of = np.searchsorted(begins, found, side="right") - 1
        own = pdf["alone"].to_numpy(dtype=bool)[of]
        found, of = found[own], of[own]
        edge = np.ones(len(found), dtype=bool)  # runs of neighbouring windows
        edge[1:] = (np.diff(found) != 1) | (np.diff(of) != 0)
        a = np.flatnonzero(edge)
        z = np.append(a[1:], len(found)) - 1 if len(found) else a
        shift = pdf["pos"].to_numpy(dtype=np.int64)[of] - begins[of]
        return pd.DataFrame({ROW: pdf[ROW].to_numpy(dtype=np.int64)[of[a]], "s": found[a] + shift[a], "e": found[z] + shift[z] + least})

    cut = _cut_texts(rows, cold.select(ROW, "shard", "pos", "windows", "alone"), f"shard long, {ROW} long, pos long, alone boolean, data binary", slices)
    found = cut.groupBy("shard").applyInPandas(search, f"{ROW} long, s long, e long")
    if hot is None:
        return found

    def windows(row: int, data: bytes, items) -> list[tuple]:
        return [(hashlib.blake2b(data[p:p + least], digest_size=16).digest(), row, p, x["alone"])
                for x in items for p in range(x["pos"], x["pos"] + x["windows"])]

    each = stored(_cut_texts(rows, hot.select(ROW, "pos", "windows", "alone"), f"window binary, {ROW} long, s long, alone boolean", windows), "windows")
    often = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return found.unionByName(each.where("alone").join(often, "window", "left_semi").select(ROW, "s", (F.col("s") + least).alias("e")))


def repeated_spans(rows: DataFrame, least: int = LEAST, shard_bytes: int = 1 << 18, hot_bytes: int = 1 << 22) -> DataFrame:
    """(ROW, spans): the byte ranges to remove, merged and in order, of each text of ``rows`` (ROW, text) that has any."""
    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(keys, texts):
            of, pos, n, name, content, again = segments(texts, least)
            return pd.DataFrame({ROW: np.array(keys, dtype=np.int64)[of], "pos": pos, "windows": n, "name": name, "content": content, "again": again})

        keys, texts, size = [], [], 0
        for pdf in batches:
            for key, text in zip(pdf[ROW], pdf["text"]):
                data = text.encode()
                if len(data) >= least:
                    keys.append(key)
                    texts.append(data)
                    size += len(data)
                    if size >= 1 << 20:
                        yield done(keys, texts)
                        keys, texts, size = [], [], 0
        if texts:
            yield done(keys, texts)

    every = stored(rows.where("text IS NOT NULL").select(ROW, "text").mapInPandas(named, f"{ROW} long, pos long, windows long, name long, content long, again boolean"), "segments")
    often = every.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    some = every.join(often, "name", "left_semi")
    some = stored(some.unionByName(every.where("again").join(often, "name", "left_anti")), "segments")

    contents = stored(some.groupBy("name", "content").agg(F.count("*").alias("n"), F.min(F.struct(ROW, "pos", "windows")).alias("one"), F.bool_or("again").alias("again")), "contents")
    names = contents.groupBy("name").agg(F.count("*").alias("contents"), F.count_if(F.col("n") == 1).alias("single"),
                                         F.bool_or((F.col("n") == 1) & F.col("again")).alias("again"))
    names = names.where("single > 0 AND (contents > 1 OR again)").select("name")
    chosen = stored(contents.join(names, "name", "left_semi").select("name", "one.*", (F.col("n") == 1).alias("alone")), "chosen")
    whole = some.join(contents.where("n > 1").select("name", "content"), ["name", "content"], "left_semi") \
        .select(ROW, F.col("pos").alias("s"), (F.col("pos") + F.col("windows") + least - 1).alias("e"))
    found = whole.unionByName(_examined(rows, chosen, least, shard_bytes, hot_bytes))

    def merged(spans: pd.Series) -> pd.Series:
        out = []
        for x in spans:
            both = np.array(sorted((r["s"], r["e"]) for r in x), dtype=np.int64)
            reach = np.maximum.accumulate(both[:, 1])
            first = np.flatnonzero(np.append(True, both[1:, 0] > reach[:-1]))
            out.append([{"s": s, "e": e} for s, e in zip(both[first, 0].tolist(), reach[np.append(first[1:], len(both)) - 1].tolist())])
        return pd.Series(out)

    merge = F.pandas_udf(merged, "array<struct<s:long,e:long>>")
    return found.groupBy(ROW).agg(F.collect_list(F.struct("s", "e")).alias("spans")).select(ROW, merge("spans").alias("spans"))


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes)."""
    bound_batches(docs.sparkSession)
    rows = with_row_key(docs, id_col, text_col).select(ROW, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = stored(repeated_spans(rows.select(ROW, "text"), least, **how), "spans")

    @F.pandas_udf("binary")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, spans):
            if text is None or cut is None:
                out.append(None)
                continue
            data, at, kept = text.encode(), 0, []
            for x in cut:
                kept.append(data[at:x["s"]])
                at = x["e"]
            out.append(b"".join([*kept, data[at:]]))
        return pd.Series(out, dtype=object)

    joined = rows.join(spans, ROW, "left")
    return joined.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "spans",
                         F.coalesce(rest(F.when(F.col("spans").isNotNull(), F.col("text")), "spans"), F.col("text").cast("binary")).alias("kept"))
