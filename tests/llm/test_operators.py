"""Every operator against brute force on small tables with nulls, empty and long texts, ties,
repeated rows and clashing column names; and the empty table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import public_tokenizers
from matingstats.llm import (bpe_matrix, chat_events, decontaminate, host_reputation, queries, secret_scan, simhash_vp,
                             stream_dedup, suffix_dedup, token_store, toxicity)
from matingstats.llm.common import ROW, new_folder

CLASH = "doc_id long, text string, words string, id string, h long, fp string, spans long, n int, keep string, score string, file string, digest string"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", "i", 1, "f", 2, 3, "k", "s", "p", "d") for d, t in rows], CLASH)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _texts(seed, n=60):
    r = random.Random(seed)
    vocab = ["the", "token", "Éa", "ñ", "x1", "password", "aa", "B", "ab\ncd", "don't", "漢字", "a-b", "idiot"]
    line = " ".join(r.choice(vocab) for _ in range(80))
    out = [None, "", " ", "\n\n", "a", "The", "the", "THE", "É", "é", line, line.upper(), line, "aaaa" * 200, ("ab" * 150) + line,
           'token = "abcdef1" password:short secret:token:abcdef', "AKIA" + "X" * 16, "AKIA" + "X" * 15, "0" * 23 + " " + "f" * 24, "AKIAKIA" + "9" * 20]
    while len(out) < n:
        words = [r.choice(vocab) for _ in range(r.randrange(1, 120))]
        if r.random() < 0.3:
            words.insert(r.randrange(len(words)), line)
        out.append(r.choice([" ", "  ", "\t "]).join(words))
    return out


@pytest.fixture(scope="module")
def docs():
    texts = _texts(1)
    return list(zip(random.Random(2).sample(range(1000), len(texts)), texts))


def _op1(df, bench, **how):
    found = decontaminate.report(df, bench, **how)
    return _rows(found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), "contaminated"))


@pytest.mark.parametrize("max_set,max_hashes", [(100_000, 1), (0, 10**6), (0, 3)])  # the shipped set, one pass beyond it, many
def test_decontamination(spark, docs, max_set, max_hashes):
    items = [(1, "the token éa ñ x1 password aa b ab cd don t the"), (2, "x1 Aa"), (3, None), (4, ""), (5, "don't"), (None, "aa b"), (2, "x1 Aa"),
             (6, " ".join(docs[20][1].split()[:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _op1(_frame(spark, docs), bench, max_set=max_set, max_hashes=max_hashes) == sorted(brute.op1(docs, items), key=str)
    kept = decontaminate.remove_documents(_frame(spark, docs), bench, max_set=max_set, max_hashes=max_hashes)
    bad = {r[0] for r in brute.op1(docs, items) if r[5]}
    assert kept.columns == _frame(spark, docs).columns and 0 < len(bad) < len(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_decontamination_spans(spark):
    bench = spark.createDataFrame([(1, "Two three"), (2, "three four")], "item_id long, text string")
    got = decontaminate.remove_spans(_frame(spark, [(1, "(one, two THREE; four) five two"), (2, None), (3, "two three")]), bench)
    assert [(r["doc_id"], r["text"]) for r in got.orderBy("doc_id").collect()] == [(1, "(one, five two"), (2, None), (3, "")]


def _op2(df, least, **how):
    found = suffix_dedup.remove_repeats(df, least, **how)
    removed = F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.e - x.s), 0L)")
    return _rows(found.select("doc_id", "n_bytes", removed, F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256)))


@pytest.mark.parametrize("how", [{}, {"hot_bytes": 300}, {"shard_bytes": 1000}])
def test_suffix_dedup(spark, docs, how):
    assert _op2(_frame(spark, docs), 40, **how) == sorted(brute.op2(docs, 40), key=str)


def test_suffix_dedup_repeats_inside_a_text(spark):
    r = random.Random(5)
    part = "".join(r.choice("abcdefgh ") for _ in range(260))
    own = [(1, "xyz" * 130), (2, part + "--" + part), (3, part[:199]), (4, "q" + "".join(r.choice("ijklmn") for _ in range(150)) * 3)]
    assert _op2(_frame(spark, own), 200) == sorted(brute.op2(own), key=str)


def test_backward_search_finds_all_repeats():
    r = random.Random(3)
    for _ in range(60):
        least = r.choice([3, 5, 17])
        parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(least, 70))) for _ in range(r.randrange(1, 8))]
        first = np.zeros(sum(map(len, parts)), dtype=bool)
        at, places = 0, []
        for p in parts:
            first[at] = True
            places += [(p[i:i + least], at + i) for i in range(len(p) - least + 1)]
            at += len(p)
        count = brute.Counter(s for s, _ in places)
        assert suffix_dedup.repeats(np.frombuffer(b"".join(parts), dtype=np.uint8), first, least).tolist() == [i for s, i in places if count[s] > 1]


def test_toxicity_finds_words_and_sentences(spark):
    r = random.Random(4)
    rows, labels = [], []
    for d in range(600):
        words = [[r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(8)] for _ in range(6)]
        toxic = d % 4 == 0
        if toxic:
            words[2][3] = r.choice(["nastyx", "nastyy", "nastyzz", "vile"])
        rows.append((d, ". ".join(map(" ".join, words))))
        labels.append((d, int(toxic)))
    frame = _frame(spark, rows).drop("score")
    model = toxicity.fit(frame, spark.createDataFrame(labels + [(None, 1), (3, None), (8, 0)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(frame, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [d for d in got if got[d]["out"]]
    assert len(held) > 100 and all((got[d]["score"] >= 0.7) == (d % 4 == 0) for d in held)
    for d in held:
        if d % 4 == 0:
            assert [rows[d][1][o["start"]:o["end"]].split()[3] for o in got[d]["offending"]] == [rows[d][1].split(". ")[2].split()[3]]
    odd = toxicity.score(_frame(spark, [(1, None), (2, ""), (2, ""), (3, "VILE " * 20000)]).drop("score"), model).collect()
    assert [round(x["score"], 6) for x in odd[:3]] == [round(model.leak, 6)] * 3 and odd[3]["score"] > 0.7


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(_frame(spark, docs), none)
    assert {r["score"] for r in toxicity.score(_frame(spark, docs).drop("score"), model).collect()} == {0.0}


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows = [(d, "vile" if d % 2 else "kind") for d in range(300)]
    ids = [r["doc_id"] for r in _frame(spark, rows).where(toxicity.held_out(F.col("doc_id"))).collect()]
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, toxic int")
    assert toxicity.fit(_frame(spark, rows), labels) == toxicity.Model()


def _op4(df, **how):
    base = F.expr("filter(spans, s -> s.rule < 3)")
    count = [F.expr(f"size(filter(spans, s -> s.rule = {k}))") for k in range(3)]
    joined = F.array_join(F.transform(base, lambda s: F.concat(s.kind, F.lit(":"), s.start, F.lit(":"), s["end"])), ",")
    return _rows(secret_scan.scan(df, **how).select("doc_id", *count, F.sha2(joined, 256)))


@pytest.mark.parametrize("max_broadcast", [200_000, 0])
def test_secrets(spark, docs, max_broadcast):
    r = random.Random(6)
    parts = ["token", "=", ":", '"', " ", "secret", "api_key", "APIKEY", "abc", "AKIA", "A1", "f", "0a1b2c3d4e5f6a7b8c9d0e1f", "é", "\n", "passwd", "pass"]
    more = docs + [(5000 + i, "".join(r.choice(parts) for _ in range(r.randrange(60)))) for i in range(300)]
    assert _op4(_frame(spark, more), max_broadcast=max_broadcast) == sorted(brute.op4(more), key=str)


def test_other_secret_rules(spark):
    text = "x -----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10
    spans = secret_scan.scan(_frame(spark, [(1, text)])).first()["spans"]
    assert [(s["kind"], text[s["start"]:s["end"]][:4]) for s in spans] == [("pem", "----"), ("github", "ghp_"), ("hex", "aaaa"), ("jwt", "eyJa")]


def test_trigram_queries():
    q = secret_scan.trigram_query(secret_scan.RULES[0].pattern)
    assert len(q) == 1 and {frozenset(["tok", "oke", "ken"]), frozenset(["sec", "ecr", "cre", "ret"])} < set(q[0])
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{16,}") == [[frozenset(["aki", "kia"])]]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == [] and secret_scan.trigram_query("a?b?|cdef") == []


def test_simhash(spark, docs):
    r = random.Random(7)
    base = [r.choice("abcdefghijklm") * r.randrange(1, 5) for _ in range(300)]
    near = []
    for i in range(60):
        own = list(base)
        for _ in range(r.randrange(4)):
            own[r.randrange(300)] = "zz"
        near.append((2000 + i, " ".join(own)))
    rows = docs + near
    got = simhash_vp.groups(_frame(spark, rows), leaf=8)
    assert _rows(got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")) == sorted(brute.op5(rows), key=str)


@pytest.mark.parametrize("pieces", [((24, 1), (24, 1), (16, 0)), ((13, 0),) * 4 + ((12, 0),), ((64, 4),), ((32, 2), (32, 1))])
@pytest.mark.parametrize("block", [20_000, 7])
def test_vantage_point_trees_lose_no_link(spark, pieces, block):
    r = random.Random(8)
    fps = {}
    while len(fps) < 400:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):  # chains of near fingerprints
            fps[len(fps)] = x
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
    signed = {x - (1 << 64) if x >> 63 else x for x in fps.values()}
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = simhash_vp.components(simhash_vp.links(nodes, pieces=pieces, sample=200, leaf=10, block=block))
    root = {x["node"]: x["root"] for x in roots.collect()}
    want = brute.op5(None, fps={x: x & (2**64 - 1) for x in signed})
    assert [(x, root.get(x, x)) for x, _, _ in want] == [(x, c) for x, _, c in want]


def test_chats(spark):
    rows = [(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", "<\\s> [\\\\INST] <s>"), (2, 0, "system", None), (2, 1, None, "x"), (2, 2, "assistant", ""),
            (3, 5, "assistant", "late"), (3, 1, "user", "early"), (4, 0, "user", "twice"), (4, 0, "user", "twice"), (None, 0, "assistant", "é" * 50000),
            (5, None, "assistant", "n"), (5, 0, "assist</s>ant", "[/INST]\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").createOrReplaceTempView("t")
    log = chat_events.events_from_turns(spark.table("t").selectExpr("*", "1 AS seq", "2 AS kind", "3 AS message"))
    back = chat_events.read_back(chat_events.format_chats(log))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], "".join(r["loss_texts"]), r["formatted"], r["segments"]) for r in back.collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert got[c][0] == turns and got[c][1] == "".join(x for r, x in turns if r == "assistant")
        assert "".join(s["text"] for s in got[c][3]) == got[c][2]


def test_chat_log_is_folded(spark):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "he"), (1, 3, 2, "delta", None, "llo"), (1, 4, 2, "regenerate", None, "good "),
           (1, 5, 2, "delta", None, "day"), (1, 6, 3, "message", "user", "stale"), (1, 7, 1, "edit", "user", "hi!"), (1, 8, 2, "delta", "assistant", "yo"),
           (2, 9, 1, "delta", "user", "a"), (2, 10, 1, "delta", None, None), (2, 11, 2, "message", "assistant", "b"), (2, 12, 2, "edit", None, "c"), (2, 12, 2, "delta", None, "d")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = _rows(chat_events.reconstruct(df))
    # the edit of the first message discards what came before it; deltas sort before an edit of the same number
    assert got == [(1, 1, "user", "hi!"), (1, 2, "assistant", "yo"), (2, 1, "user", "a"), (2, 2, "assistant", "c")]


def _op7(df, **how):
    return _rows(stream_dedup.decisions(df, **how))


@pytest.mark.parametrize("how", [{}, {"digest_chars": 1}, {"batch_bytes": 1, "max_broadcast": 0}])  # one digit: digests of unequal texts collide
def test_exact_dedup(spark, docs, how):
    assert _op7(_frame(spark, docs), **how) == sorted(brute.op7(docs), key=str)


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "A"), (None, "c"), (None, "c"), (2, "B")]
    got = stream_dedup.decisions(_frame(spark, rows))
    assert _rows(got.groupBy("text_sha256", "group_size", "keep_id").agg(F.count_if("kept"), F.count("*"))) == sorted(
        [(brute.sha("a"), 3, 1, 1, 3), (brute.sha("b"), 2, 2, 1, 2), (brute.sha("c"), 2, None, 1, 2)], key=str)
    for keep in (stream_dedup.deduplicate, lambda f: simhash_vp.deduplicate(f, max_bits=0, pieces=((64, 0),))):
        left = keep(_frame(spark, rows))
        assert left.columns == _frame(spark, rows).columns and left.count() == 3


def test_token_files(spark, docs):
    path = new_folder(spark, "tokens")
    token_store.write_tokens(_frame(spark, docs), path, public_tokenizers.path("byte_bpe_50k.json"), shards=3, block_tokens=50)
    assert spark.read.parquet(path).count() > 5
    assert _rows(token_store.read_tokens(spark, path)) == sorted(brute.op8(docs), key=str)


def test_token_files_of_null_and_repeated_ids(spark):
    path = new_folder(spark, "tokens")
    rows = [(5, "a b"), (None, "c"), (5, "a b"), (-3, None)]
    token_store.write_tokens(_frame(spark, rows), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert [r[:3] for r in sorted(map(tuple, token_store.read_tokens(spark, path).collect()), key=lambda r: r[1])] == [(None, 0, 2), (-3, 2, 1), (5, 3, 3), (5, 6, 3)]


def test_elias_fano():
    r = random.Random(9)
    for _ in range(100):
        v = np.concatenate([[0], np.cumsum([r.choice([0, 1, 7, 3000, r.randrange(1, 10**6)]) for _ in range(r.randrange(1, 500))])])
        ef = token_store.EliasFano.of(v)
        which = np.array([r.randrange(len(v)) for _ in range(20)])
        assert (ef.select(which) == v[which]).all()
        assert 8 * (len(ef.low) + len(ef.high)) <= len(v) * (3 + np.log2(max(2, v[-1] / len(v)))) + 16


def test_bpe(spark, docs):
    r = random.Random(10)
    odd = ["".join(r.choice("ab \n\t'sé1!漢 \x1c🙂") for _ in range(r.randrange(80))) for _ in range(300)]
    more = docs + [(9000 + i, t) for i, t in enumerate([*odd, "a" * 3000, "ab" * 2000 + " " + "x" * 700, "<|endoftext|> <|endoftext|>"])]
    got = queries.bpe_digests(_frame(spark, more).select("doc_id", "text"))
    assert _rows(got) == sorted(brute.op9(more), key=str)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_matrix.encode(_frame(spark, more), ranks, public_tokenizers.PATTERN)
    assert "words" in coded.columns
    back = bpe_matrix.decode(coded.select("doc_id", "ids"), ranks)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {d: (t or "").encode() for d, t in more}


def test_library_chunks_equal_whole_texts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(11)
    texts = [t for _, t in docs] + ["".join(r.choice("ab \n\t'sé1!漢 ") for _ in range(r.randrange(80))) for _ in range(300)] + ["a <|endoftext|>b <|endoftext|>"]
    with open(path, encoding="utf-8") as f:
        own = token_store.LibraryEncoder(f.read())
    whole = Tokenizer.from_file(path)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_remembered_words_are_bounded_in_bytes():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = token_store.LibraryEncoder(f.read())
    own.REMEMBER = 100_000
    most = 0
    for k in range(200):  # without a blank every text is a chunk of its own
        texts = [f"w{k}x{j}" * 5 for j in range(50)]
        got = own.encode(texts)
        most = max(most, len(own.plain) + len(own.after_blank))
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got[:2]] == [own.tokenizer.encode(t).ids for t in texts[:2]]
    assert most < 1000


def test_other_splittings_go_to_the_library_whole():
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        described = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**described["pre_tokenizer"], "add_prefix_space": True}},
                   {"pre_tokenizer": {**described["pre_tokenizer"], "use_regex": False}}):
        model = json.dumps({**described, **change})
        whole, texts = Tokenizer.from_str(model), ["The cat, the Hat", " a  b", "x", "", None]
        got = token_store.LibraryEncoder(model).encode(texts)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_of_text_ids(spark):
    path = new_folder(spark, "tokens")
    rows = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, "")], "doc_id string, text string")
    token_store.write_tokens(rows, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_store.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[:3] for r in got] == [(None, 0, 1), ("a", 1, 2), ("b", 3, 3)]


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://net"), (3, "x://net/"), (4, None), (5, "no scheme/net/"), (6, "http://example.com/de/#a"), (7, "http://www.org/fr/"),
            (8, "http://u:p@example.org:80/fr/"), (9, "://bad.net/x://y"), (10, ""), (11, "http://ÉXAMPLE.net/fr\n/"), (1, "http://A.Example.NET/en/x?y"), (12, "http://a.bnet/")]
    pages = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, host string, suffix string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = host_reputation.filter_urls(pages, none)
    assert _rows(got.select("page_id", "host", "path", "rule", "verdict")) == sorted([(*r[:4], r[4] or "allow") for r in brute.op10(rows)], key=str)


def test_reputation_shrinks_to_the_parent(spark):
    pages = [(i, f"http://{h}/{i}") for i, h in enumerate(["bad.spam.com"] * 40 + ["new.spam.com"] + ["ok.good.com"] * 40 + ["one.good.com"])]
    bad = [(i, int("spam" in u)) for i, u in pages if "new" not in u and "one" not in u] + [(81, 1), (0, None)]
    got = {r["host"]: r for r in host_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), rules=()).collect()}
    assert got["bad.spam.com"]["verdict"] == "block" and got["ok.good.com"]["verdict"] == "allow"
    assert got["new.spam.com"]["mean"] > 0.7  # no label of its own: as its domain
    assert got["one.good.com"]["mean"] < 0.9 and got["one.good.com"]["verdict"] == "allow"  # one bad page among good siblings
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got.values())


def test_trees_grow_until_their_leaves_are_small(spark):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 63, 19_000, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 19_000, dtype=np.uint64)
    near = base[:1000].copy()
    for _ in range(4):  # up to four bits away
        near ^= np.uint64(1) << draw.integers(0, 64, 1000, dtype=np.uint64)
    values = np.unique(np.concatenate([base, near]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    sizes = simhash_vp.shards(fps, sample=100, leaf=60, most=300).groupBy("shard").agg(F.count_if("home").alias("h")).collect()
    assert len(sizes) > 100 and max(r["h"] for r in sizes) <= 300  # a sample of 100 alone gives some ten leaves of thousands
    homes = sum(r["h"] for r in sizes)
    assert homes == 3 * len(values)  # every fingerprint is at home once in each tree
    edges = simhash_vp.links(fps, sample=100, leaf=60, most=300).collect()
    group = {int(v): int(v) for v in values.view(np.int64)}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in edges:
        group[root(r["a"])] = root(r["b"])
    found = {}
    for v in group:
        found.setdefault(root(v), set()).add(v)
    want = {int(v): int(v) for v in values.view(np.int64)}
    group, pairs = want, []
    for at in range(0, len(values), 500):
        i, j = np.nonzero(np.bitwise_count(values[at:at + 500, None] ^ values[None, :]) <= 4)
        pairs += zip((i + at).tolist(), j.tolist())
    signed = values.view(np.int64).tolist()
    for i, j in pairs:
        group[root(signed[i])] = root(signed[j])
    exact = {}
    for v in group:
        exact.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, exact.values()))
    assert sum(len(x) > 1 for x in exact.values()) >= 900


ODD_COLUMNS = ["a.b", "__row", "score", "offending", "ids", "decoded", "whole", "id", "found", "words", "h", "kept", "text2", "runs", "n_words", "x`y"]


@pytest.mark.parametrize("name,replaced", [("remove_documents", []), ("remove_spans", []), ("near", []), ("exact", []), ("toxicity", ["score", "offending"]), ("encode", ["ids", "decoded"]),
                                           ("runs", ["runs", "n_words"]), ("quality", ["score"])])
def test_columns_of_any_name_are_kept(spark, name, replaced):
    from matingstats.llm import neighbour_quality, periodic_runs

    rows = [(1, "one two three four"), (2, "five six"), (None, None), (2, "seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(ODD_COLUMNS)])
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    run = {"remove_documents": lambda d: decontaminate.remove_documents(d, bench), "remove_spans": lambda d: decontaminate.remove_spans(d, bench, max_set=0),
           "near": simhash_vp.deduplicate, "exact": stream_dedup.deduplicate, "toxicity": lambda d: toxicity.score(d, toxicity.Model(), keep_text=True),
           "encode": lambda d: bpe_matrix.encode(d, ranks, public_tokenizers.PATTERN, decoded_col="decoded"),
           "runs": periodic_runs.with_runs, "quality": lambda d: neighbour_quality.score(d, neighbour_quality.fit(d, spark.createDataFrame([], "doc_id long, quality int")))}[name]
    got = run(docs)
    assert got.count() == len(rows)
    for k, c in enumerate(ODD_COLUMNS):
        if c not in replaced:
            assert {r[0] for r in got.select("`" + c.replace("`", "``") + "`").collect()} == {f"v{k}"}
    if name in ("remove_documents", "remove_spans", "near", "exact"):
        assert got.columns == docs.columns


def test_empty_tables(spark):
    empty = _frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.remove_documents(empty, bench).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert toxicity.score(empty.drop("score"), toxicity.Model()).count() == 0
    assert secret_scan.scan(empty).count() == 0
    assert simhash_vp.groups(empty).count() == 0 and simhash_vp.deduplicate(empty).count() == 0
    assert chat_events.format_chats(spark.createDataFrame([], "conv_id long, seq long, message long, kind string, role string, text string")).count() == 0
    assert stream_dedup.decisions(empty).count() == 0 and stream_dedup.deduplicate(empty).count() == 0
    path = new_folder(spark, "tokens")
    token_store.write_tokens(empty, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, path).count() == 0
    assert queries.bpe_digests(empty.select("doc_id", "text")).count() == 0
    assert host_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert ROW not in decontaminate.report(empty, bench).columns
