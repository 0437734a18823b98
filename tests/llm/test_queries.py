"""The registered queries at sf0.001: against their DuckDB SQL and against brute force; and the pipeline."""

import zlib

import duckdb
import pytest

import brute
import corpus_pipeline
from matingstats.llm import toxicity
from matingstats.llm.queries import queries
from matingstats.llm.sql import oracle_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, con, name):
    df = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert _sorted(df.select(*cols).collect()) == _sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_suffix_dedup", "op4_secrets", "op5_simhash", "op6_chat", "op7_exact_dedup", "op8_token_store", "op9_bpe", "op10_url_filter", "op11_periodic_runs", "op13_collocations"])
def test_brute_force(spark, con, name):
    docs = con.execute("select doc_id, text from documents").fetchall()
    n = int(name[2:].split("_")[0])
    args = {1: [docs, con.execute("select item_id, text from benchmark").fetchall()], 6: [con.execute("select conv_id, turn, role, text from conversations").fetchall()],
            10: [con.execute("select page_id, url from pages").fetchall()], 13: [con.execute("select lang, text from documents").fetchall()]}.get(n, [docs])
    want = [tuple(r) for r in getattr(brute, f"op{n}")(*args)]
    got = [tuple(r) for r in queries()[name](spark, SF).collect()]
    if n == 10:  # the method's own verdicts are not in the contract
        want, got = [r[:4] for r in want], [r[:4] for r in got]
    assert _sorted(r[:len(want[0])] for r in got) == _sorted(want)


def test_toxicity_held_out(spark, con):
    sf = SF.replace("0.001", "0.01")
    rows = queries()["op3_toxicity"](spark, sf).collect()
    labels = dict(con.execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    assert len(rows) == con.execute(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.93


def test_quality_held_out(spark, con):
    sf = SF.replace("0.001", "0.01")
    rows = queries()["op12_quality"](spark, sf).collect()
    labels = dict(con.execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert len(rows) == con.execute(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_pipeline(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = [(d, t) for d, t in con.execute("select doc_id, text from documents").fetchall() if scorer.score(t)[0] < corpus_pipeline.TOXIC]
    keep = {r[0] for r in brute.op7(left) if r[3]}
    left = [x for x in left if x[0] in keep]
    keep = {r[0] for r in brute.op5(left) if r[0] == r[2]}
    left = [x for x in left if x[0] in keep]
    bad = {r[0] for r in brute.op1(left, con.execute("select item_id, text from benchmark").fetchall()) if r[5]}
    left = [x for x in left if x[0] not in bad]
    assert _sorted(corpus_pipeline.run(spark, SF).collect()) == _sorted(brute.op9(left))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "'x' AS score", "1 AS words", "2 AS id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
