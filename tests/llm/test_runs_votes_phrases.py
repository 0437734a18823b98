"""Operators 11 to 13 on small tables: against brute force, and the cases that their docstrings define."""

import random

import numpy as np
import pytest

import brute
from matingstats.llm import collocations, neighbour_quality, periodic_runs
from matingstats.llm.neighbour_quality import Model, Terms, learn, votes, weighted

DOCS = "doc_id long, text string, lang string"


def _periodic(draw, most=6):
    out = []
    for _ in range(draw.randint(1, most)):
        base = [draw.choice("abcdefgh"[:draw.choice([1, 2, 8])]) for _ in range(draw.randint(1, 20))]
        out += (base * draw.randint(1, 9))[:draw.randint(1, 150)]
    return out


# ---- operator 11

@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(10):
        texts = [" ".join(_periodic(draw)) for _ in range(4)]
        for least, times in ((24, 3), (6, 3), (9, 4), (10, 5)):
            sizes, found, left = periodic_runs.find(texts, least, times)
            for t, n, r, c in zip(texts, sizes, found, left):
                w = t.split()
                assert (n, r) == (len(w), brute.runs(w, least, times))
                gone = {i for s, m, q in r for i in range(s + q, s + m)}
                assert c == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_tree_has_every_suffix_and_extension():
    draw = np.random.default_rng(3)
    for size in (1, 2, 5):
        s = [*(draw.integers(1, size + 1, 60).tolist()), 0]
        tree = periodic_runs.suffix_tree(s, size + 1)
        leaves, shared = periodic_runs.tour(tree, len(s), size + 1)
        assert leaves.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        ext = periodic_runs.Extensions(leaves, shared)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i.tolist(), j.tolist())]
        assert ext(i, j).tolist() == want


def test_runs_defined_cases(spark):
    text = "x " + "a b c " * 10 + "y"
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, text, None), (2, None, "en"), (3, "", "en"), (4, " \t\n", "en"), (5, "a b " * 30, "en")], DOCS)
    docs = docs.selectExpr("*", "'old' AS runs", "7 AS n_words", "'keep' AS `a.b`", "'k' AS __row")
    got = periodic_runs.with_runs(docs)
    assert got.columns == ["doc_id", "lang", "a.b", "__row", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["a.b"]) for r in rows] == [
        *[(d, 32, [(1, 30, 3)], "x a b c y", "keep") for d in (1, 1, None)], *[(d, 0, [], "", "keep") for d in (2, 3, 4)], (5, 30, [(0, 30, 1)], "a b", "keep")]
    assert periodic_runs.with_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs, times=2)


def test_runs_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    words[100_000:100_900] = ["p", "q", "r"] * 300
    docs = spark.createDataFrame([(1, " ".join(words), "en")], DOCS)
    row = periodic_runs.with_runs(docs).first()
    assert row["n_words"] == 300_000 and [tuple(x) for x in row["runs"]] == [(100_000, 900, 3)]


# ---- operator 12

def test_votes_equal_brute_force():
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "of", "Ab!", "x|", "12", "zz"]) for _ in range(draw.randint(0, 30))) for _ in range(60)]
    texts += texts[:5] + ["", None]
    terms = Terms(most=3)
    rows = [terms.counts(t) for t in texts]
    good = np.array([draw.random() < 0.5 for _ in texts], dtype=float)
    model = learn(rows, good, 8, 5, 4.0)
    x = [list(map(float, r)) for r in weighted(rows, model.rarity) @ model.axes]
    for k, score in enumerate(votes(model, rows)):
        size = sum(v * v for v in x[k]) ** 0.5 or 1.0
        near = [round(sum(a * b for a, b in zip(x[k], own)) / size, 9) for own in model.vectors.tolist()]
        last = sorted(near, reverse=True)[4]
        weight = [max(c, 0.0) ** 4 if c >= last else 0.0 for c in near]
        want = (sum(w * g for w, g in zip(weight, good)) + 1e-3 * good.mean()) / (sum(weight) + 1e-3)
        assert abs(score - want) < 1e-6


def test_latent_space_is_the_truncated_decomposition():
    terms = Terms()
    draw = random.Random(1)
    rows = [terms.counts(" ".join(draw.choice(["red", "green", "blue", "one", "two"]) for _ in range(20))) for _ in range(50)]
    model = learn(rows, np.ones(50), 4, 3, 1.0)
    x = weighted(rows, model.rarity)
    exact = np.linalg.svd(x)[1]
    assert np.allclose(np.sqrt(((x @ model.axes) ** 2).sum(axis=0)), exact[:4], rtol=1e-6)


def test_quality_defined_cases(spark):
    rows = [(i, "good words here " * (i % 7 + 1), "en") for i in range(40)] + [(100 + i, "BAD!! BAD!! " * (i % 7 + 1), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _, _ in rows] + [(None, 0), (3, None), (5, 0)], "doc_id long, quality int")
    model = neighbour_quality.fit(docs, labels, dims=8, nearest=3)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None), (7, "", "en"), (7, " \n", "en")], DOCS)).selectExpr("*", "'x' AS score", "1 AS `a.b`")
    got = neighbour_quality.score(odd, model)
    assert got.columns == ["doc_id", "lang", "a.b", "score"]
    found = got.collect()
    assert len(found) == 83
    assert all((r["score"] > 0.9) == (r["doc_id"] < 100) for r in found[:80])
    assert len({round(r["score"], 9) for r in found[80:]}) == 1 and abs(found[80]["score"] - model.good.mean()) < 1e-9
    assert neighbour_quality.score(odd.limit(0), model).collect() == []
    empty = neighbour_quality.fit(docs, labels.limit(0))
    assert isinstance(empty, Model) and {r["score"] for r in neighbour_quality.score(odd, empty).collect()} == {0.5}


def test_quality_learns_nothing_from_held_out_labels(spark):
    rows = [(i, f"text number {i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = {r["doc_id"] for r in docs.where(neighbour_quality.held_out(docs["doc_id"])).collect()}
    model = neighbour_quality.fit(docs, labels, dims=4)
    assert 0 < len(held) and len(model.good) == 60 - len(held)


# ---- operator 13

@pytest.mark.parametrize("seed", range(20))
def test_multikey_quicksort_counts(seed):
    draw = np.random.default_rng(seed)
    for depths in (1, 2, 4):
        s = draw.integers(0 if depths > 1 else 1, 5, (depths, 300)).astype(np.int32)
        s[0] += s[0] == 0
        for d in range(1, depths):
            s[d][s[d - 1] == 0] = 0
        w = draw.integers(1, 4, 300)
        want = {}
        for k in range(300):
            key = tuple(s[:, k].tolist())
            want[key] = want.get(key, 0) + int(w[k])
        at, n = collocations.frequent(s, w, 6)
        assert len(at) == len(set(at.tolist()))
        assert {tuple(s[:, a].tolist()): m for a, m in zip(at.tolist(), n.tolist())} == {k: v for k, v in want.items() if v >= 6}


def _mined(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 5, 7), (2, 3, 2000)])
def test_phrases_equal_brute_force(spark, longest, least, top):
    draw = random.Random(longest)
    rows = []
    for k in range(120):
        words = [draw.choice(["New", "York", "the", "of", "a b", "Été", "x", "y", "z\tq"]) + draw.choice(["", "", "", ",", "\n", " . "]) for _ in range(draw.randint(0, 60))]
        rows.append((k, " ".join(words), draw.choice(["en", "de de", None, "und"])))
    rows += [(None, None, "en"), (1, "", "fr"), (1, "one two", "en"), (1, "one two", "en")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 AS part", "2 AS f", "3 AS phrase")
    got = collocations.mine(docs, longest, least, top=top, salts=3, bucket_chars=500, batch_chars=700)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert _mined(got) == sorted(brute.op13([(r[2], r[1]) for r in rows], longest, least, top=top), key=str)


def test_phrases_of_a_very_long_text_and_of_none(spark):
    text = "alpha beta gamma " * 500_000  # 8.5 MB in one piece, cut into slices
    docs = spark.createDataFrame([(1, text, "en")], DOCS)
    got = {r["phrase"]: (r["a"], r["n"]) for r in collocations.mine(docs).collect()}
    assert got == {"alpha beta gamma": (500_000, 1_500_000), "beta gamma alpha": (499_999, 1_500_000), "gamma alpha beta": (499_999, 1_500_000)}
    assert collocations.mine(docs.limit(0)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    counts = [("en", 0, None, 10**16), ("en", 1, "a", 10**14 + 1), ("en", 1, "b", 10**14 + 3), ("en", 2, "a b", 10**14 - 7)]
    table = spark.createDataFrame(counts, "lang string, m int, phrase string, f long")
    original = collocations.phrase_counts
    collocations.phrase_counts = lambda *_, **__: table
    try:
        row = collocations.mine(table).first()
    finally:
        collocations.phrase_counts = original
    assert row["score"] == 10**6 * (10**14 - 7) ** 2 // ((10**14 + 1) * (10**14 + 3)) and row["n"] == 10**16


def test_strings_combine_beyond_packed_numbers():
    draw = np.random.default_rng(1)
    size = 1 << 31
    columns = [draw.choice([1, 5, size - 1], 200) for _ in range(4)]
    got, n = collocations.combined(columns, size)
    want = {}
    for key in zip(*(c.tolist() for c in columns)):
        want[key] = want.get(key, 0) + 1
    assert dict(zip(zip(*(c.tolist() for c in got)), n.tolist())) == want
