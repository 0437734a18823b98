"""Operator 5: SimHash near-duplicates by vantage-point trees.

Fingerprints are cut into pieces of bits. If two of them differ in at most ``max_bits`` bits, then in at
least one piece they differ in no more bits than that piece's budget (the budgets plus one add up to more
than ``max_bits``). Over each piece stands a vantage-point tree: a node splits the fingerprints by their Hamming
distance to a vantage point at a threshold, and its leaves are the shards. A fingerprint is at home
in one leaf of each tree. By the triangle bound, a partner within the budget is on the other side of a node only if the
distance lies within the budget of the threshold: such a fingerprint also visits the boundary-overlapping
shards beyond it, all other branches are pruned. In each shard homes are compared
with all members exactly, over all 64 bits. Every link lies in some shard.

One tree over whole fingerprints with the full budget would be exact too, but its nodes cannot prune: distances
of unrelated fingerprints to any vantage point crowd around 32 with a deviation of 4, so seven tenths lie within 4 bits of
any useful threshold. Pieces keep the budgets, and thereby the overlaps, small.

The trees grow with the data: first from a bounded sample (``sample`` fingerprints, the smallest by hash), then leaves with more than ``most``
homes get a tree of their own from a sample of their members, and so on until no leaf is larger or no vantage point splits it. Samples only steer
the partitioning, all fingerprints are routed. Equal fingerprints are one node. A leaf with over ``block``
members is dealt as pairs of blocks. A shard returns a spanning forest of the links in it, never all pairs;
components come from alternating large-star and small-star rounds, each written to the shared folder.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; a null
identifier is above all others in the choice of the smallest, a component of only such has a null id; repeated rows
are rows with equal fingerprints; an empty table gives an empty result; other columns are ignored by ``groups`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import ROW, ascii_lower, batches_of, by_value, maybe_broadcast, once, stored, with_row_key, with_whole_rows

by_value(__name__)

#: (bits, budget) of the pieces; 2 + 2 + 1 > 4.
PIECES = ((24, 1), (24, 1), (16, 0))
SHINGLE = 4
MAX_BITS = 4


def shingle_hashes(text, n: int = SHINGLE):
    """Columns words and, from it, XXH64 (seed 42) of each run of ``n`` words, repeats included; of all words if fewer; none if no words."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return words, F.expr(f"""CASE WHEN size(words) = 0 THEN array()
        WHEN size(words) < {n} THEN array(xxhash64(array_join(words, ' ')))
        ELSE transform(sequence(0, greatest(size(words) - {n}, 0)), i -> xxhash64(array_join(slice(words, i + 1, {n}), ' '))) END""")


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes``."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at:at + step], dtype=np.int64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``docs`` with the column fp (long) instead of the text."""
    @F.pandas_udf("long")
    def voted(hashes: pd.Series) -> pd.Series:
        return pd.Series([majority(x) for x in hashes], dtype="int64")

    words, hashes = shingle_hashes(F.col(text_col), n)
    return once(docs, words=words).withColumn("fp", voted(hashes)).drop("words", text_col)


def _distance(values: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(point)) & np.uint64(mask))


def build_tree(values: np.ndarray, mask: int, budget: int, leaf: int, tries: int = 12) -> list:
    """Nodes [point, threshold, inside, outside] of a tree over ``values`` (unsigned); a leaf is [None, number].

    Of ``tries`` vantage points and all thresholds the split is taken that leaves the fewest comparisons:
    members that reach each side (overlap included) times homes of that side.
    """
    nodes, leaves = [], 0
    draw = np.random.default_rng(42)
    todo = [(np.arange(len(values)), [])]  # members, the place in the parent that refers to the node
    while todo:
        own, where = todo.pop()
        me = len(nodes)
        if where:
            where[0][where[1]] = me
        best = None
        if len(own) > leaf:
            for v in draw.choice(own, min(tries, len(own)), replace=False):
                at = np.bincount(_distance(values[own], int(values[v]), mask), minlength=66)
                below = np.cumsum(at)
                for t in range(64):
                    home = int(below[t])
                    if 0 < home < len(own):
                        crossing = int(below[t] - below[t - budget]) if budget and t >= budget else (home if budget else 0)
                        cost = home * home + (len(own) - home) * (len(own) - home + crossing)
                        if best is None or cost < best[0]:
                            best = (cost, int(values[v]), t)
        if best is None or best[0] > 0.9 * len(own) ** 2:
            nodes.append([None, leaves])
            leaves += 1
            continue
        node = [best[1], best[2], None, None]
        nodes.append(node)
        inside = _distance(values[own], best[1], mask) <= best[2]
        todo += [(own[~inside], (node, 3)), (own[inside], (node, 2))]
    return nodes


def route(values: np.ndarray, nodes: list, mask: int, budget: int, home: bool = True) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, places in ``values``, whether at home there); ``home``: whether they are at home in what the tree stands over."""
    todo = [(0, np.arange(len(values)), home)]
    while todo:
        k, own, home = todo.pop()
        if not len(own):
            continue
        if nodes[k][0] is None:
            yield nodes[k][1], own, home
            continue
        point, t, inside, outside = nodes[k]
        d = _distance(values[own], point, mask).astype(np.int64)
        if home:  # a pair meets once: the inner one visits the outer side
            todo += [(inside, own[d <= t], True), (outside, own[d > t], True), (outside, own[(d <= t) & (d + budget > t)], False)]
        else:
            todo += [(inside, own[d - budget <= t], False), (outside, own[d + budget > t], False)]


def linked(members: np.ndarray, home: np.ndarray, max_bits: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of ends, of the links that a home has with any member."""
    seen = np.zeros(len(members), dtype=bool)
    homes = np.flatnonzero(home)
    for at in range(0, len(homes), step):
        rows = homes[at:at + step]
        d = np.bitwise_count(members[rows, None] ^ members[None, :])
        d[np.arange(len(rows)), rows] = 65
        near = d <= max_bits
        seen[rows] |= near.any(axis=1)
        seen |= near.any(axis=0)
    left = members[seen]
    a, b = [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:step], front[step:]
            near = (np.bitwise_count(now[:, None] ^ left[None, :]) <= max_bits).any(axis=0)
            if near.any():
                found, left = left[near], left[~near]
                front = np.concatenate([front, found])
                b.append(found)
                a.append(np.full(len(found), root, dtype=np.uint64))
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


#: Shard numbers of one tree.
_TREE = 1 << 40


def _leaves(nodes: list) -> int:
    return sum(n[0] is None for n in nodes)


def shards(nodes: DataFrame, pieces=PIECES, sample: int = 1 << 14, leaf: int = 1000, most: int = 16_000) -> DataFrame:
    """(shard, fp, home): the members of all leaves of the trees over ``pieces``; about ``leaf`` homes each, more than ``most`` only where no
    vantage point splits them."""
    spark, total = nodes.sparkSession, nodes.count()
    some = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()  # at most ``sample`` rows
    values = np.array([r["fp"] for r in some], dtype=np.int64).view(np.uint64)
    masks, low = [], 0
    for bits, budget in pieces:
        masks.append((((1 << bits) - 1) << low, budget))
        low += bits
    trees = [build_tree(values, mask, budget, max(2, int(leaf * len(values) / max(total, 1)))) for mask, budget in masks]
    used = [_leaves(t) for t in trees]

    def frame(found: list) -> pd.DataFrame:
        shard, fp, home = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"shard": shard, "fp": fp, "home": home})

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy()
            found = [(np.full(len(own), k * _TREE + at), fps[own], np.full(len(own), home)) for k, (made, (mask, budget)) in enumerate(zip(trees, masks))
                     for at, own, home in route(fps.view(np.uint64), made, mask, budget)]
            if found:
                yield frame(found)

    # a row grows about tenfold here, so the few bytes of a node are dealt out first
    dealt = nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    layout = "shard long, fp long, home boolean"
    with batches_of(spark, 10_000):
        members = stored(dealt.mapInPandas(routed, layout), "shards")
    ready = []
    while True:
        sizes = members.groupBy("shard").agg(F.count_if("home").alias("h")).where(F.col("h") > most)
        large = {r["shard"]: r["h"] for r in sizes.orderBy(F.col("h").desc(), "shard").limit(max(1, sample // 64)).collect()}
        if not large:
            break
        share = max(2, sample // len(large))
        at = F.broadcast(spark.createDataFrame(list(large.items()), "shard long, h long"))  # at most sample / 64 rows
        seen = (members.where("home").join(at, "shard").where(F.pmod(F.xxhash64("fp", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("h") / share))) == 0)
                .select("shard", "fp").limit(4 * sample).collect())
        own: dict[int, list[int]] = {k: [] for k in large}
        for x in seen:
            own[x["shard"]].append(x["fp"])
        grown = {}
        for k, fps in own.items():
            mask, budget = masks[k // _TREE]
            values = np.array(sorted(fps), dtype=np.int64).view(np.uint64)
            made = build_tree(values, mask, budget, max(2, int(leaf * len(values) / large[k])))
            if _leaves(made) > 1:
                grown[k] = made, (k // _TREE) * _TREE + used[k // _TREE]
                used[k // _TREE] += _leaves(made)

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for (k, home), part in pdf.groupby(["shard", "home"]):
                    made, first = grown[k]
                    fps = part["fp"].to_numpy()
                    found += [(np.full(len(own), first + at), fps[own], np.full(len(own), there))
                              for at, own, there in route(fps.view(np.uint64), made, *masks[k // _TREE], bool(home))]
                if found:
                    yield frame(found)

        whole = [k for k in large if k not in grown]
        if whole:
            ready.append(members.where(F.col("shard").isin(whole)))
        again = members.where(F.col("shard").isin(list(grown)))
        rest = members.where(~F.col("shard").isin(list(large)))
        with batches_of(spark, 10_000):
            members = stored(rest.unionByName(again.mapInPandas(split, layout)), "shards")
    for part in ready:
        members = members.unionByName(part)
    return members


def links(nodes: DataFrame, max_bits: int = MAX_BITS, pieces=PIECES, block: int = 20_000, **how) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes`` (distinct fp) within ``max_bits``."""
    if sum(p for p, _ in pieces) != 64 or sum(b + 1 for _, b in pieces) <= max_bits:
        raise ValueError("the pieces must have 64 bits, and budgets that leave no pair out")
    members = shards(nodes, pieces, **how)
    # one row per leaf of a tree: they grow with the fingerprints
    sizes = members.groupBy("shard").agg(F.count("*").alias("m"), F.count_if("home").alias("h"))
    sizes = sizes.select("shard", F.ceil(F.col("h") / block).cast("int").alias("gh"), F.ceil(F.col("m") / block).cast("int").alias("gm")).where("gh > 0")
    dealt = members.join(maybe_broadcast(sizes, 100_000), "shard").withColumn("at", F.expr("""CASE
        WHEN gh = 1 AND gm = 1 THEN array(named_struct('i', 0, 'j', 0, 'home', home))
        ELSE concat(transform(sequence(0, gh - 1), i -> named_struct('i', i, 'j', CAST(pmod(xxhash64(fp, 1), gm) AS int), 'home', false)),
                    IF(home, transform(sequence(0, gm - 1), j -> named_struct('i', CAST(pmod(xxhash64(fp, 2), gh) AS int), 'j', j, 'home', true)),
                       CAST(array() AS array<struct<i:int,j:int,home:boolean>>))) END""")) \
        .select("shard", "fp", F.explode("at").alias("at")).select("shard", "at.i", "at.j", "fp", "at.home")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby("fp", as_index=False)["home"].max()  # in a dealt leaf one may be on both sides
        a, b = linked(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(dtype=bool), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not itself the smallest of its component."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(CAST(xxhash64(b, a) AS decimal(20,0)))").alias("s")).first()
        if new == mark or not new["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                     .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")


def _grouped(keyed: DataFrame, id_col: str, text_col: str, n: int, max_bits: int, **how) -> DataFrame:
    """(ROW, id, fp, first) of every row; first is (id is null, id, ROW) of its component's first row."""
    with batches_of(keyed.sparkSession, 500):  # a row has a hash for each word
        rows = stored(fingerprints(keyed.select(ROW, F.col(id_col).alias("id"), F.col(text_col).alias("text")), n=n), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits, **how))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = nodes.groupBy("root").agg(F.min("first").alias("first"))
    nodes = nodes.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(nodes, "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, max_bits: int = MAX_BITS, **how) -> DataFrame:
    """One row per document: its id, fp (long) and component_id, the smallest id reachable over links."""
    found = _grouped(with_row_key(docs, id_col, text_col), id_col, text_col, n, max_bits, **how)
    return found.select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, max_bits: int = MAX_BITS,
                max_broadcast: int = 1_000_000, **how) -> DataFrame:
    """``docs`` with the first document (smallest id) of each group; all columns stay."""
    keyed = with_whole_rows(docs, id_col, text_col)
    found = _grouped(keyed, "id", "text", n, max_bits, **how)
    dropped = stored(found.where(F.col("first")[ROW] != F.col(ROW)).select(ROW), "dropped")
    return keyed.join(maybe_broadcast(dropped, max_broadcast), ROW, "left_anti").select("whole.*")
