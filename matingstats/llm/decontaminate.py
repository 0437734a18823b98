"""Operator 1: benchmark decontamination.

The words of every benchmark item give windows of ``n`` consecutive words (an item with fewer
words is one window). Their 64-bit hashes form a hash set that is shipped to every task; each document's
word windows are looked up in it as they are scanned, and every hit is verified on the
words themselves. One pass over the documents, no shuffle of texts.

The set is a literal in the plan, so its size is counted first. Beyond ``max_set`` windows it is a broadcast table of the hashes alone, in
ranges of ``max_hashes`` and a pass for each: windows are looked up as they are made, and only those found
are shuffled, to meet the words they are verified by. Memory is that of one range, whatever the benchmark's size.

Defined results: a null or empty text, or one without words, has no hits; null or empty
items are no windows; an item with a null id gives hits but is not listed; repeated benchmark items
count by id; repeated documents are judged one by one; an empty table gives an empty result; other
columns are kept by the filters and ignored by the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import ROW, ascii_lower, maybe_broadcast, once, quoted, small_enough, sql_string, stored, with_row_key

WINDOW = 13
#: Windows that may be shipped as a literal set (about 100 bytes each, with their words).
MAX_SET = 100_000

#: Hashes that may be broadcast at once (about 16 bytes each).
MAX_HASHES = 4_000_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none if it is null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, key, len, hash, head): ``key`` are the window's words, ``hash`` and ``head`` hash the window and its first word."""
    w = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.select("item_id", F.explode(F.expr(
        f"IF(size(w) >= {n}, transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n})), array(w))")).alias("w"))
    return w.select("item_id", F.expr("array_join(w, ' ')").alias("key"), F.size("w").alias("len"),
                    F.expr("xxhash64(transform(w, x -> xxhash64(x)))").alias("hash"), F.expr("xxhash64(w[0])").alias("head")).distinct()


def _positions(length: int, test: str) -> str:
    """SQL: structs (pos, len) of the windows of ``length`` words at which ``test`` of i holds."""
    return (f"IF(size(h) < {length}, array(), transform(filter(sequence(0, greatest(size(h) - {length}, 0)), i -> {test}), "
            f"i -> named_struct('pos', i, 'len', {length})))")


def _by_set(docs: DataFrame, windows: list) -> DataFrame:
    """Adds ``hits`` by lookups in the shipped sets."""
    def listed(values) -> str:
        return ", ".join(sorted(f"{v}L" for v in values)).replace("-9223372036854775808L", "-9223372036854775807L - 1L")

    found = []
    for length in sorted({w["len"] for w in windows}):
        own = [w for w in windows if w["len"] == length]
        test = f"xxhash64(slice(h, i + 1, {length})) IN ({listed({w['hash'] for w in own})})"
        # a shorter item is rare: its first word is looked up before the window is hashed
        found.append(_positions(length, f"h[i] IN ({listed({w['head'] for w in own})}) AND {test}"))
    keys = ", ".join(sorted({sql_string(w["key"]) for w in windows}))
    none = "CAST(array() AS array<struct<pos:int,len:int>>)"
    named = (f"transform(concat({', '.join(found) or none}), c -> "
             "named_struct('pos', c.pos, 'len', c.len, 'key', array_join(slice(words, c.pos + 1, c.len), ' ')))")
    return once(docs, hits=F.expr(f"filter({named}, c -> c.key IN ({keys}))" if windows else named))


def _by_passes(docs: DataFrame, windows: DataFrame, max_hashes: int) -> DataFrame:
    """Adds ``hits`` by broadcast sets of hashes, as many passes as they need: only windows whose hash is a benchmark's go on, to be
    joined with the words for the verification on the row."""
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # at most n values
    wanted = windows.select("hash", "len", "key").distinct()
    hashes = wanted.select("hash").distinct()
    passes = -(-hashes.count() // max_hashes)
    at = F.explode(F.expr("flatten(array(" + ", ".join(_positions(n, "true") for n in lengths) + "))"))
    seen = docs.select(ROW, "h", at.alias("c")).select(ROW, "c.pos", "c.len", F.expr("xxhash64(slice(h, c.pos + 1, c.len))").alias("hash"))
    parts = [seen.join(F.broadcast(hashes.where(F.pmod("hash", F.lit(passes)) == k)), "hash", "left_semi") for k in range(passes)]
    some = stored(reduce(DataFrame.unionByName, parts), "candidates")
    found = (some.join(wanted, ["hash", "len"])
             .groupBy(F.col(ROW).alias("of")).agg(F.collect_list(F.struct("pos", "len", "key")).alias("found")))
    docs = docs.join(maybe_broadcast(found, MAX_SET), docs[ROW] == found["of"], "left").drop("of")
    return once(docs, hits=F.expr("""filter(coalesce(found, array()),
        c -> array_join(slice(words, c.pos + 1, c.len), ' ') = c.key)""")).drop("found")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET, max_hashes: int = MAX_HASHES) -> DataFrame:
    """``docs`` (text, and a key ``ROW`` that stays when tasks run again) and n_words, n_hit and hits (pos, len, key), sorted and verified."""
    windows = benchmark_windows(benchmark, n)
    docs = once(docs, words=words(F.col("text")))
    docs = once(docs, h=F.expr("transform(words, x -> xxhash64(x))"))
    distinct = windows.select("key", "len", "hash", "head").distinct()
    if small_enough(distinct, max_set):
        docs = _by_set(docs, distinct.collect())
    else:
        docs = _by_passes(docs, windows, max_hashes)
    covered = """aggregate(array_sort(hits), named_struct('end', 0, 'n', 0L), (a, c) -> named_struct(
        'end', greatest(a.end, c.pos + c.len),
        'n', a.n + greatest(0, c.pos + c.len - greatest(a.end, c.pos))), a -> a.n)"""
    docs = once(docs, n_hit=F.expr(covered))
    return docs.withColumn("n_words", F.size("words").cast("long")).withColumn("hits", F.array_sort("hits")).drop("words", "h")


def _whole_rows(docs: DataFrame, benchmark: DataFrame, n: int, max_set: int) -> DataFrame:
    """(whole, ROW, text): the set lookup needs no key; where rows are joined again their numbers are written first, so that they stay."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("whole")).withColumn(ROW, F.monotonically_increasing_id())
    if not small_enough(benchmark_windows(benchmark, n).select("key").distinct(), max_set):
        rows = stored(rows, "rows")
    return rows.withColumn("text", F.col("whole").getField("text"))


def is_contaminated() -> Column:
    """At least one word in twenty lies inside a benchmark window."""
    return F.expr("n_hit > 0 AND 20 * n_hit >= n_words")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET, max_hashes: int = MAX_HASHES) -> DataFrame:
    """``docs`` without the contaminated ones; all columns and all other rows stay."""
    kept = find_hits(_whole_rows(docs, benchmark, n, max_set), benchmark, n, max_set, max_hashes).where(~is_contaminated())
    return kept.select("whole.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET, max_hashes: int = MAX_HASHES) -> DataFrame:
    """``docs`` with every hit word, and the separators up to the next word, cut from ``text``; null stays null."""
    cols = docs.columns
    hit = find_hits(_whole_rows(docs, benchmark, n, max_set), benchmark, n, max_set, max_hashes)
    spans = F.expr("""aggregate(hits, CAST(array() AS array<struct<s:int,e:int>>), (a, c) -> IF(
        size(a) > 0 AND c.pos <= a[size(a) - 1].e,
        concat(slice(a, 1, size(a) - 1), array(named_struct('s', a[size(a) - 1].s, 'e', greatest(a[size(a) - 1].e, c.pos + c.len)))),
        concat(a, array(named_struct('s', c.pos, 'e', c.pos + c.len)))))""")
    cut = F.expr("""concat(lead, array_join(flatten(transform(sequence(0, size(spans)), i -> slice(pieces,
        IF(i = 0, 0, spans[i - 1].e) + 1, IF(i = size(spans), size(pieces), spans[i].s) - IF(i = 0, 0, spans[i - 1].e)))), ''))""")
    hit = (hit.withColumn("spans", spans)
           .withColumn("pieces", F.regexp_extract_all("text", F.lit(_ANY_WORD + _SEPARATORS), F.lit(0)))
           .withColumn("lead", F.regexp_extract("text", "^" + _SEPARATORS, 0))
           .withColumn("text", F.when(F.col("n_hit") > 0, cut).otherwise(F.col("text"))))
    return hit.select(*[F.col("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in cols])


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET, id_col: str = "doc_id", max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (sorted strings), contaminated."""
    hit = find_hits(with_row_key(docs, id_col, "text"), benchmark, n, max_set, max_hashes)
    seen = hit.select(ROW, id_col, "n_words", "n_hit",
                      F.explode_outer(F.expr("array_distinct(transform(hits, c -> c.key))")).alias("key"))
    items = benchmark_windows(benchmark, n).where("item_id IS NOT NULL").select("key", F.col("item_id").cast("string").alias("item"))
    if items.limit(max_set + 1).count() <= max_set:
        items = F.broadcast(items)
    return (seen.join(items, "key", "left").groupBy(ROW, id_col, "n_words", "n_hit")
            .agg(F.array_sort(F.collect_set("item")).alias("items"))
            .select(id_col, "n_words", "n_hit", "items", is_contaminated().alias("contaminated")))
