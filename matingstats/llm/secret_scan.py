"""Operator 4: secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match must
contain the trigrams of one of the alternatives of each clause. The index holds, for each trigram
that some query names, the documents whose lower-cased text contains it; postings are
intersected per document and only the candidates are verified with the regular expression.
Rules without mandatory trigrams (``hex``) scan every text.

Postings are rows (gram, row), never lists per gram, and are pre-aggregated per document, so a
gram found in every document is as cheap as any other. The candidate list is broadcast only if
its counted size is within ``max_broadcast`` rows; otherwise the join shuffles. Positions come
from the lengths of matches and of the text between them, summed up in a window per
document.

Defined results: a null or empty text has no spans; repeated documents are scanned one by one; an
empty table gives an empty result; other columns are ignored. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matingstats.llm.common import ROW, maybe_broadcast, sql_string, stored, with_row_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # the runs below are maximal, so a minimum in the pattern drops what a check of the length would
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: Alternatives of a clause beyond which a run of literals is cut.
_MOST = 32


def _alternatives(nodes) -> set[str] | None:
    """The finite set of strings that a piece of a parsed pattern matches, or None."""
    out = {""}
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            own = {chr(arg)}
        elif name == "SUBPATTERN":
            own = _alternatives(arg[-1])
        elif name == "BRANCH":
            each = [_alternatives(x) for x in arg[1]]
            own = None if None in each else set().union(*each)
        elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            own = {chr(c) for _, c in arg}
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            own = _alternatives(arg[2])
            own = None if own is None else own | {""}
        else:
            own = None
        if own is None or len(out) * len(own) > _MOST:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must hold) of trigrams (all must occur), lower-cased.

    An empty list: the pattern has no mandatory trigram.
    """
    clauses, run = [], {""}

    def cut() -> None:
        if min(map(len, run)) >= 3:
            grams = {frozenset(s[i:i + 3].lower() for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((g for g in grams if not any(o < g for o in grams)), key=sorted))

    def pieces(nodes):  # the sequence with plain groups opened
        for op, arg in nodes:
            if str(op) == "SUBPATTERN" and _alternatives([(op, arg)]) is None:
                yield from pieces(arg[-1])
            else:
                yield op, arg

    for op, arg in pieces(_parser.parse(pattern)):
        own = _alternatives([(op, arg)])
        if own is not None and len(run) * len(own) <= _MOST:
            run = {a + b for a, b in product(run, own)}
            continue
        cut()
        run = own if own is not None else {""}
    cut()
    return clauses


def trigram_index(docs: DataFrame, grams: list[str], text_col: str = "text") -> DataFrame:
    """Postings (gram, ROW) of the named trigrams, stored in the shared folder."""
    listed = ", ".join(map(sql_string, grams))
    low = docs.select(ROW, F.lower(text_col).alias("low"))
    return stored(low.select(F.explode(F.expr(f"filter(array({listed}), g -> contains(low, g))")).alias("gram"), ROW), "postings")


def candidates(index: DataFrame, queries: dict[int, list]) -> DataFrame:
    """(ROW, rules): the rules, by number, whose Boolean query the document's postings meet."""
    def holds(query) -> str:
        def every(grams) -> str:
            return "(" + " AND ".join(f"array_contains(grams, {sql_string(g)})" for g in sorted(grams)) + ")"
        return " AND ".join("(" + " OR ".join(map(every, clause)) + ")" for clause in query)

    met = ", ".join(f"IF({holds(q)}, {k}, -1)" for k, q in queries.items())
    return (index.groupBy(ROW).agg(F.collect_set("gram").alias("grams"))  # of the named grams only
            .select(F.col(ROW).alias("candidate"), F.expr(f"filter(array({met}), k -> k >= 0)").alias("rules")).where("size(rules) > 0"))


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 200_000) -> DataFrame:
    """One row per document: its id and spans (start, rule, kind, end), sorted; rule is the place in ``rules``."""
    keyed = with_row_key(docs, id_col, text_col)
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
    if queries:
        found = maybe_broadcast(stored(candidates(trigram_index(keyed, grams, text_col), queries), "candidates"), max_broadcast)
        keyed = keyed.join(found, keyed[ROW] == found["candidate"], "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<int>"))
    none = "CAST(array() AS array<struct<rule:int,i:int,gap:int,len:int,glen:int>>)"

    def matches(k: int, r: Rule) -> str:
        p, t = sql_string(r.pattern), f"`{text_col}`"
        test = f"array_contains(rules, {k})" if k in queries else f"{t} RLIKE {p}"
        return f"""IF(coalesce({test}, false), transform(
            arrays_zip(regexp_extract_all({t}, {p}, 0), regexp_extract_all({t}, {p}, {r.group}),
                       slice(split({t}, {p}, -1), 1, size(regexp_extract_all({t}, {p}, 0)))),
            (x, i) -> named_struct('rule', {k}, 'i', i, 'gap', length(x.`2`), 'len', length(x.`0`), 'glen', length(x.`1`))), {none})"""

    each = keyed.select(ROW, id_col, F.explode_outer(F.expr(f"concat({', '.join(matches(k, r) for k, r in enumerate(rules))})")).alias("x"))
    each = each.select(ROW, id_col, "x.*").repartition(ROW)
    upto = Window.partitionBy(ROW, "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.expr("CASE rule " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules)) + " END")
    kind = F.expr("CASE rule " + " ".join(f"WHEN {k} THEN {sql_string(r.kind)}" for k, r in enumerate(rules)) + " END")
    end = F.sum(F.expr("CAST(gap + len AS bigint)")).over(upto)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rule", kind.alias("kind"), "end")
    return (each.withColumn("end", end).groupBy(ROW, id_col)
            .agg(F.array_sort(F.collect_list(F.when(F.col("glen") >= least, span))).alias("spans"))
            .select(id_col, "spans"))
