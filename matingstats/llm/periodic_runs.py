"""Operator 11: runs of periodically repeated words, by longest common extensions in suffix trees.

A run is a stretch of consecutive words with smallest period q and a length of at least ``least`` words and ``times`` periods that no
neighbouring word extends with that period. Every run contains a Lyndon word of length q that is the longest Lyndon word at
its start, for the order of the words or for the reversed order (runs theorem; Bannai et al. 2017). So the longest Lyndon words at all
places, for both orders, are the candidates: each is extended to the right and to the left by two longest common extensions.

Of a stretch of words, and of its reversal, Ukkonen's algorithm builds the suffix tree. A depth-first tour lists the leaves and, between two
successive leaves, the depth of the shallowest node on the way, their lowest common ancestor; a sparse table over the tour gives
the ancestor's depth of any two leaves, which is their longest common extension, in constant time. The tour's order of leaves is the order of
the suffixes: the longest Lyndon word at a place ends before the next place with a smaller suffix.

Trees are built only where a run can be. A run of length n and period q has windows of n - 2 q words, 8 or more by default; each
occurs a period earlier or later in the run too. So the places whose window (by 64-bit hash) occurs once in its document cut it into stretches,
those in turn by windows that occur once in the stretch, until nothing changes; stretches shorter than ``least`` hold no run. A
collision of hashes only keeps a stretch that holds no run. Documents are independent, so there is no shuffle; memory is that
of one batch of texts and of the trees of one stretch.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; repeated rows
are treated one by one; an empty table gives an empty result; all other columns are kept, but ``n_words``, ``runs`` and
``collapsed``, which the results replace.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import bound_batches, by_value, quoted

by_value(__name__)

#: Least length of a run, in words and in periods.
LEAST, TIMES = 24, 3


def suffix_tree(s: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's suffix tree of ``s``, whose last symbol occurs once; symbols are below ``size``.

    Edges (node * size + first symbol -> child), and the begin and end in ``s`` of the edge into each node; the root is
    node 0, the edges of leaves end at len(s).
    """
    n = len(s)
    edges: dict[int, int] = {}
    begin, end, link = [0], [0], [0]
    node = edge = length = left = 0  # the active point, and the suffixes still to be entered
    for i, c in enumerate(s):
        left += 1
        inner = 0  # the inner node made last, whose link is missing
        while left:
            if not length:
                edge = i
            key = node * size + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                b = begin[child]
                span = end[child] - b
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[b + length] == c:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                split = len(begin)
                edges[key] = split
                edges[split * size + s[b + length]] = child
                edges[split * size + c] = split + 1
                begin += (b, i)
                end += (b + length, n)
                link += (0, 0)
                begin[child] = b + length
                if inner:
                    link[inner] = split
                inner = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return edges, begin, end


def tour(tree: tuple[dict[int, int], list[int], list[int]], n: int, size: int, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The leaves, as starts of suffixes, in the order of a depth-first tour, and the depth of the lowest common ancestor of each leaf and the one before.

    Children are visited by rising symbols; ``falling``: by falling ones. The symbol 0, the end, is first in both.
    """
    edges, begin, end = tree
    keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
    to = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
    owner, symbol = keys // size, keys % size
    if falling:
        symbol = (size - symbol) % size
    order = np.lexsort((-symbol, owner))  # a stack hands them out the other way round
    first = np.searchsorted(owner[order], np.arange(len(begin) + 1)).tolist()
    child = to[order].tolist()
    span = (np.array(end) - np.array(begin)).tolist()
    depth = [0] * len(begin)
    above = [0] * len(begin)  # depth of the parent
    leaves, shared = [], []
    stack = child[first[0]:first[1]]
    low = 0
    fresh = True  # nothing visited since the last leaf
    while stack:
        v = stack.pop()
        if fresh:
            low = above[v]
            fresh = False
        d = above[v] + span[v]
        a, z = first[v], first[v + 1]
        if a == z:
            leaves.append(n - d)
            shared.append(low)
            fresh = True
        else:
            own = child[a:z]
            for x in own:
                above[x] = d
            stack += own
    return np.array(leaves, dtype=np.int64), np.array(shared, dtype=np.int64)


class Extensions:
    """Longest common extensions of places of a string, by lowest common ancestors in its suffix tree."""

    def __init__(self, leaves: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(leaves), dtype=np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.table = [shared.astype(np.int32)]
        step = 1
        while 2 * step <= len(shared):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # the smallest of the depths a to b - 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k)])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Ends of the longest Lyndon words at all places: the next place whose suffix is smaller. The last place is the end symbol."""
    n = len(rank) - 1
    ranks, out, stack = rank.tolist(), [0] * n, [n]
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of codes, by start, then period."""
    n = len(words)
    if n < least:
        return []
    codes = np.unique(words, return_inverse=True)[1] + 1
    size = int(codes.max()) + 1
    ahead, back = codes.tolist(), codes[::-1].tolist()
    ahead.append(0)
    back.append(0)
    tree = suffix_tree(ahead, size)
    leaves, shared = tour(tree, n + 1, size)
    right = Extensions(leaves, shared)
    other = np.empty(n + 1, dtype=np.int64)
    other[tour(tree, n + 1, size, falling=True)[0]] = np.arange(n + 1)
    del tree
    left = Extensions(*tour(suffix_tree(back, size), n + 1, size))
    found = set()
    i = np.arange(n)
    for rank in (right.rank, other):
        j = lyndon_ends(rank)
        q = j - i
        start = i - left(n - i, n - j)
        length = j + right(i, j) - start
        ok = (length >= least) & (length >= times * q)
        found.update(zip(start[ok].tolist(), length[ok].tolist(), q[ok].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def window(least: int, times: int) -> int:
    """The least n - 2 q of a run: n is at least ``least`` and q at most n / times."""
    return min(least - 2 * (least // times), (times - 2) * (least // times + 1))


def stretches(words: np.ndarray, begins: np.ndarray, least: int, width: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of ``words`` in which a run can be; documents start at ``begins``."""
    n = len(words) - width + 1
    if n < 1:
        return []
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[k:n + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    at = np.arange(n)
    part = np.searchsorted(begins, at, side="right")
    inside = part == np.searchsorted(begins, at + width - 1, side="right")
    at, part = at[inside], part[inside]
    while True:
        ok = _again(h[at] * np.uint64(0x94D049BB133111EB) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        kept, old = at[ok], part[ok]
        if not len(kept):
            return []
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (np.diff(kept) != 1) | (np.diff(old) != 0)
        group = np.cumsum(new)
        long = np.bincount(group)[group] + width - 1 >= least
        kept, group = kept[long], group[long]
        if len(kept) == len(at):
            break
        at, part = kept, group
    first = np.flatnonzero(np.append(True, np.diff(group) != 0))
    return [(a, z + width) for a, z in zip(kept[first].tolist(), kept[np.append(first[1:], len(kept)) - 1].tolist())]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, q in runs:
        gone[start + q:start + length] = b"\1" * (length - q)
    return b" ".join([w for w, g in zip(words, gone) if not g])


def find(texts: list[str | None], least: int = LEAST, times: int = TIMES) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """Numbers of words, runs and collapsed texts."""
    each = [(t or "").encode().split() for t in texts]  # bytes are split at \x20 and \x09 to \x0D only
    sizes = [len(w) for w in each]
    codes: dict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    flat = np.fromiter((codes[w] for words in each for w in words), dtype=np.int64, count=sum(sizes))
    begins = np.cumsum([0, *sizes])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.unique(begins[:-1])
    for a, z in stretches(flat, starts, least, window(least, times)):
        d = int(np.searchsorted(begins, a, side="right")) - 1
        shift = a - int(begins[d])
        runs[d] += [(shift + s, length, q) for s, length, q in runs_of(flat[a:z], least, times)]
    return sizes, runs, [_collapsed(w, r).decode() for w, r in zip(each, runs)]


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, batch_chars: int = 1 << 21) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; words are numbered from 0, by start, then period) and collapsed instead of the text.

    ``times`` is 3 or more. Texts are taken up to about ``batch_chars`` characters at a time.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    bound_batches(docs.sparkSession)
    made = ("n_words", "runs", "collapsed")

    @F.pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: tuple[list, list, list] = ([], [], [])
            some, chars = [], 0
            for k, t in enumerate(texts):
                some.append(t)
                chars += len(t or "")
                if chars >= batch_chars or k == len(texts) - 1:
                    for whole, part in zip(out, find(some, least, times)):
                        whole += part
                    some, chars = [], 0
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in out[1]]
            yield pd.DataFrame({"n_words": pd.Series(out[0], dtype="int64"), "runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(out[2], dtype=object)})

    kept = [quoted(c) for c in docs.columns if c != text_col and c not in made]
    # a generator's columns stay columns: Catalyst would copy the function into lambdas that use its result
    return docs.select(*kept, F.inline_outer(F.array(found(quoted(text_col)))).alias(*made))
