"""Learnt and statistical parts of operators 3 and 10 against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matingstats.functions.special import lgamma_sql
from matingstats.llm import host_reputation, toxicity


# ---- operator 3: noisy-or over sentences

MODEL = toxicity.Model({"vile": 2.0, "vil*": 0.5, "worth*": 1.5, "ok": -1.0}, bias=-1.0, leak=0.02)


def _by_hand(text):
    """Every word of every sentence, every feature, one after the other."""
    clean, found = 1 - MODEL.leak, []
    start = 0
    for k, c in enumerate([*(text or ""), "."]):
        if c in ".!?\n":
            sentence = (text or "")[start:k]
            words = "".join(x if x.isalnum() or x == "_" else " " for x in sentence.lower()).split()
            own = {f for f in MODEL.weights for w in words if (w.startswith(f[:-1]) and len(w) > len(f) - 1 if f.endswith("*") else w == f)}
            if own:
                p = 1 / (1 + math.exp(-(MODEL.bias + sum(MODEL.weights[f] for f in own))))
                clean *= 1 - p
                if p > 0.5:
                    found.append((start, k))
            start = k + 1
    return 1 - clean, found


def test_scores_and_sentences_by_hand(spark):
    draw = random.Random(8)
    words = ["vile", "Vile", "vilest", "worthless", "worth", "ok", "fine", "the", "evil", "vil", "ok!", "vile?", "x.", "\n"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 25))) for _ in range(200)] + ["", None, "...", "vile" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, MODEL).collect()}
    for k, t in enumerate(texts):
        score, found = _by_hand(t)
        assert got[k]["score"] == pytest.approx(score, abs=1e-12), t
        assert [(o["start"], o["end"]) for o in got[k]["offending"]] == found


def test_the_fit_takes_the_gradient_of_the_likelihood():
    draw = random.Random(4)
    bags = [[sorted(draw.sample(range(4), draw.randint(1, 3))) for _ in range(draw.randint(0, 4))] for _ in range(40)]
    labels = np.array([float(any(0 in s for s in b)) if draw.random() < 0.9 else float(draw.random() < 0.5) for b in bags])
    start, ridge, rounds = np.array([0.3, 0.1, -0.2, 0.0]), 0.05, 25

    def loss(p):
        out = ridge / 2 * sum(v * v for v in p[:4])
        for y, bag in zip(labels, bags):
            clean = 1 - 1 / (1 + math.exp(-p[5]))
            for s in bag:
                clean *= 1 - 1 / (1 + math.exp(-(p[4] + sum(p[f] for f in s))))
            out -= math.log(1 - clean) if y else math.log(clean)
        return out

    # the same steps with differences of the loss for its gradient
    p, m, v = [*start, -2.0, math.log(0.02 / 0.98)], [0.0] * 6, [0.0] * 6
    for step in range(1, rounds + 1):
        g = []
        for k in range(6):
            up, down = list(p), list(p)
            up[k] += 1e-5
            down[k] -= 1e-5
            g.append((loss(up) - loss(down)) / 2e-5)
        for k in range(6):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= 0.1 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    weights, bias, leak = toxicity._noisy_or(labels, bags, 4, start, ridge, rounds)
    assert [*weights, bias, leak] == pytest.approx([*p[:4], p[4], 1 / (1 + math.exp(-p[5]))], abs=1e-4)


# ---- operator 10: suffixes and posterior bounds

@pytest.mark.parametrize("host,domain,suffix", [
    ("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("", "", ""),
    ("www.a.co.uk", "a.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.com.br", "y.com.br", "com.br"), ("x.comm.br", "comm.br", "br"),
    ("10.0.0.1", "10.0.0.1", "(address)"), ("10.0.0.1:80", "10.0.0.1", "(address)"), ("[::1]:8080", "[::1]", "(address)"), ("1.2.3", "2.3", "3"),
    ("user:pw@www.a.org:443", "a.org", "org"), ("a.org.", "a.org", "org"), ("u@v@x.ac.jp", "x.ac.jp", "ac.jp"),
])
def test_registered_domains(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "host string").select(host_reputation.registered_domain(F.col("host")), host_reputation.public_suffix(F.col("host"))).first()
    assert tuple(row) == (domain, suffix)


def _mass_below(x, a, b):
    """I_x(a, b) by sums over a fine grid of ln(x / (1 - x)), where the density is smooth."""
    u = np.linspace(-60 / min(a, 1.0), 60 / min(b, 1.0), 2_000_001)
    ln = a * u - (a + b) * np.logaddexp(0, u)
    w = np.exp(ln - ln.max())
    return w[u < math.log(x / (1 - x))].sum() / w.sum()


def test_posterior_bounds_are_beta_quantiles(spark):
    pairs = [(1.0, 1.0), (0.6, 0.9), (2.5, 40.0), (40.0, 2.5), (300.0, 290.0), (12.0, 0.7), (5000.0, 4000.0)]
    df = spark.createDataFrame(pairs, "a double, b double").withColumn("l", F.expr(f"{lgamma_sql('a')} + {lgamma_sql('b')} - {lgamma_sql('(a + b)')}"))
    got = df.select("a", "b", F.expr(host_reputation.beta_cdf_sql("0.5D", "a", "b", "l")).alias("half"),
                    F.expr(host_reputation.beta_quantile_sql("0.05D", "a", "b", "l")).alias("low")).collect()
    for r in got:
        assert r["half"] == pytest.approx(_mass_below(0.5, r["a"], r["b"]), abs=2e-4)
        assert _mass_below(r["low"], r["a"], r["b"]) == pytest.approx(0.05, abs=2e-3)


def test_verdicts_follow_the_posterior(spark):
    hosts = {"bad.a.com": (30, 28), "mixed.b.com": (30, 15), "few.c.com": (2, 2), "good.d.co.uk": (40, 1)}
    pages = [(h, k) for h, (n, _) in hosts.items() for k in range(n)]
    urls = spark.createDataFrame([(i, f"http://{h}/{k}") for i, (h, k) in enumerate(pages)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(k < hosts[h][1])) for i, (h, k) in enumerate(pages)], "page_id long, bad int")
    got = {r["host"]: r for r in host_reputation.filter_urls(urls, labels, rules=()).collect()}
    for r in got.values():
        assert 0 <= r["low"] <= r["mean"] <= r["high"] <= 1
        assert r["verdict"] == ("block" if r["low"] > 0.5 else "allow")
    assert got["bad.a.com"]["verdict"] == "block" and got["mixed.b.com"]["verdict"] == "allow" and got["good.d.co.uk"]["verdict"] == "allow"
