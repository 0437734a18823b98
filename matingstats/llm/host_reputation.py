"""Operator 10: URL filter by rules and empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. The share of bad pages of a
host is shrunk towards its registered domain, the domain's towards its public suffix and
the suffix's towards the whole table, each by a beta-binomial prior whose strength is
estimated from the data. A host is blocked when even the lower bound of its posterior, a quantile of the beta distribution,
lies above a threshold. Explicit rules come first.

Domains are those of the bare host, without user and port. The public suffix is the last label, or the last two where a generic
label stands before a country's (``co.uk``, ``com.br``); an address is its own domain under the suffix of all addresses.

Everything is grouped per host before it is joined: a host with a third of all pages
costs one row per map task in the counts. The counts are stored and read by each level. The join back to the pages is a plain
inner join of (page, url) with one row per host, which adaptive execution splits where
a host is hot.

Defined results: a null url, or one without ``://``, has an empty host and path and the
verdict of an unlabelled host; repeated pages are judged one by one; with no labels at
all nothing is blocked except by rules; an empty table gives an empty result. Other
columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matingstats.functions.special import let_sql, lgamma_sql
from matingstats.llm.common import ascii_lower, sql_string, stored

#: (verdict, host, path) in the order of the list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    host = ascii_lower(F.regexp_extract(url, _URL, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


# Generic labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"
_DOUBLE = r"^(?:.*\.)?(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$"
#: Suffix of hosts that are addresses.
ADDRESSES = "(address)"


def bare_host(host: Column) -> Column:
    """A host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def public_suffix(host: Column) -> Column:
    """What domains are registered under: the last label, or two, of a host; ``ADDRESSES`` for an address."""
    bare = bare_host(host)
    return (F.when(bare.rlike(_ADDRESS), F.lit(ADDRESSES)).when(bare.rlike(_DOUBLE), F.substring_index(bare, ".", -2))
            .otherwise(F.substring_index(bare, ".", -1)))


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it; an address as it is."""
    bare = bare_host(host)
    return (F.when(bare.rlike(_ADDRESS), bare).when(bare.rlike(_DOUBLE), F.substring_index(bare, ".", -3))
            .otherwise(F.substring_index(bare, ".", -2)))


def beta_cdf_sql(x: str, a: str, b: str, ln_beta: str) -> str:
    """I_x(a, b), the beta distribution's mass below x in (0, 1), as SQL text: its continued fraction, evaluated backwards, on the side where it
    converges fast; ``ln_beta`` is ln B(a, b)."""
    def fraction(x: str, a: str, b: str) -> str:
        # 1 + d_1 / (1 + d_2 / ...): odd and even terms
        term = (f"IF(bk % 2 = 1, -({a} + (bk - 1) / 2) * ({a} + {b} + (bk - 1) / 2) / (({a} + bk - 1) * ({a} + bk)), "
                f"(bk / 2) * ({b} - bk / 2) / (({a} + bk - 1) * ({a} + bk)))")
        depth = f"CAST(least(4000D, 60 + 4 * sqrt({a} + {b})) AS INT)"
        return f"aggregate(sequence({depth}, 1, -1), 1D, (bt, bk) -> 1D + {term} * {x} / bt)"

    front = f"exp({a} * ln({x}) + {b} * ln(1D - {x}) - {ln_beta})"
    return (f"IF({x} < ({a} + 1) / ({a} + {b} + 2), {front} / {a} / {fraction(x, a, b)}, "
            f"1D - {front} / {b} / {fraction(f'(1D - {x})', b, a)})")


def beta_quantile_sql(p: str, a: str, b: str, ln_beta: str) -> str:
    """The x with I_x(a, b) = p, by bisection to 2^-40."""
    below = beta_cdf_sql("bq.x", a, b, ln_beta)
    step = let_sql("bq", f"IF({below} < {p}, named_struct('lo', bq.x, 'hi', bs.hi), named_struct('lo', bs.lo, 'hi', bq.x))", x="(bs.lo + bs.hi) / 2")
    return f"aggregate(sequence(1, 40), named_struct('lo', 0D, 'hi', 1D), (bs, bi) -> {step}, bs -> (bs.lo + bs.hi) / 2)"


def _shrunk(level: DataFrame, parent: Column, weight: float) -> DataFrame:
    """Posterior (a, b) of a level with columns n, bad and its parent's mean as prior.

    The prior of strength s is Beta(s * parent, s * (1 - parent)). s follows from the
    level's spread around the parent's mean by the method of moments:
    E[(bad/n - m)^2] = m(1-m) (1/n + (1 - 1/n)/(s + 1)). Between 1 and ``weight``.
    """
    m = F.least(F.greatest(parent, F.lit(1e-6)), F.lit(1 - 1e-6))
    level = level.withColumn("prior", m)
    used = level.where("n > 0").agg(
        F.sum(F.expr("n * (pow(bad / n - prior, 2) - prior * (1 - prior) / n)")).alias("over"),
        F.sum(F.expr("n * prior * (1 - prior) * (1 - 1 / n)")).alias("base"))
    s = F.expr(f"""CASE WHEN over IS NULL OR base <= 0 OR over <= 0 THEN {weight}D
                   ELSE least({weight}D, greatest(1D, base / over - 1)) END""")
    return (level.crossJoin(F.broadcast(used.select(s.alias("s"))))  # one row: an aggregate without keys
            .withColumn("a", F.expr("s * prior + bad")).withColumn("b", F.expr("s * (1 - prior) + n - bad")).drop("s"))


def reputation(counts: DataFrame, weight: float = 50.0, tail: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """Posterior of each host from ``counts`` (host, n, bad): adds mean, low, high and sure.

    ``low`` and ``high`` are the posterior's quantiles at ``tail`` and 1 - ``tail``, or its mean where that lies outside of them (very skewed
    posteriors); ``sure``: ``low`` lies above ``threshold``, that is, the mean does and the mass below the threshold is less than ``tail``. Hosts with equal posteriors share one computation.
    """
    host = counts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffix.agg(F.expr("coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5)").alias("whole"))
    suffix = _shrunk(suffix.crossJoin(F.broadcast(whole)), F.col("whole"), weight) \
        .select("suffix", F.expr("a / (a + b)").alias("suffix_mean"))
    domain = _shrunk(domain.join(suffix, "suffix"), F.col("suffix_mean"), weight) \
        .select("domain", F.expr("a / (a + b)").alias("domain_mean"))
    host = _shrunk(host.join(domain, "domain"), F.col("domain_mean"), weight)
    host = stored(host.select("host", "n", "bad", "a", "b"), "posteriors")
    each = host.select("a", "b").distinct().withColumn("ln_beta", F.expr(f"{lgamma_sql('a')} + {lgamma_sql('b')} - {lgamma_sql('(a + b)')}"))
    each = each.select("a", "b", F.expr(f"least(a / (a + b), {beta_quantile_sql(f'{tail!r}D', 'a', 'b', 'ln_beta')})").alias("low"),
                       F.expr(f"greatest(a / (a + b), {beta_quantile_sql(f'{(1 - tail)!r}D', 'a', 'b', 'ln_beta')})").alias("high"),
                       F.expr(f"a / (a + b) > {threshold!r}D AND {beta_cdf_sql(f'{threshold!r}D', 'a', 'b', 'ln_beta')} < {tail!r}D").alias("sure"))
    return host.join(each, ["a", "b"]).select("host", "n", "bad", F.expr("a / (a + b)").alias("mean"), "low", "high", "sure")


def _rules_of_host(rules) -> Column:
    """The rules that fit a host, the longest first, as array of (verdict, rule, path)."""
    made = ", ".join(f"named_struct('verdict', {sql_string(v)}, 'rule', {sql_string(h + p)}, 'host', {sql_string(h)}, "
                     f"'path', {sql_string(p)})" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)))
    return F.expr(f"filter(array({made}), r -> host = r.host OR endswith(host, concat('.', r.host)))")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.5,
                weight: float = 50.0, tail: float = 0.05, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page: id, host, path, rule, verdict, reputation mean and bounds.

    ``outcomes`` has the id and ``bad`` (0 or 1, null: unlabelled) of labelled pages.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    seen = outcomes.where("bad IS NOT NULL").groupBy(F.col(id_col).alias("labelled_id")) \
        .agg(F.max("bad").cast("double").alias("bad"))
    counts = (parts.join(seen, parts[id_col] == seen["labelled_id"], "left").groupBy("host")
              .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    # one row per host: written once, as every level's prior reads it again
    hosts = stored(reputation(stored(counts, "hosts"), weight, tail, threshold), "reputation")
    if rules:
        hosts = hosts.withColumn("fits", _rules_of_host(rules))
        hit = F.expr("get(filter(fits, r -> startswith(path, r.path)), 0)")
    else:
        hit = F.lit(None).cast("struct<verdict:string,rule:string>")
    return (parts.join(hosts, "host").withColumn("hit", hit)
            .select(id_col, "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), F.when(F.col("sure"), "block").otherwise("allow")).alias("verdict"),
                    "mean", "low", "high"))
