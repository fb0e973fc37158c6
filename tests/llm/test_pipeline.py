import glob
import os
import re

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are elsewhere")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [d for _, d in out.dtypes] == [d for _, d in docs.dtypes]
        docs = out.checkpoint()
        n.append(docs.count())
    assert n[0] > n[1] == n[2] > n[3] >= n[4] > 0.5 * n[0]
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n[4]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(rows[0].asDict())


def test_run_goes_on(spark, monkeypatch):
    """A run that broke off in a stage begins with that stage when it is started again; only the result stays."""
    from plumbline.llm.components import shared_folder
    from plumbline.sources.store import Files

    calls, broken = [], [True]

    def stage(k):
        def run(spark, docs, sf_dir):
            calls.append(k)
            if k == 1 and broken.pop():
                raise RuntimeError("gone")
            return docs.where(f"doc_id % {k + 2} <> 1")

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage(k)) for k in range(3)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, "mine")
    broken.append(False)
    got = corpus_pipeline.run(spark, SF, "mine")
    want = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 <> 1 and doc_id % 3 <> 1 and doc_id % 4 <> 1")
    assert calls == [0, 1, 1, 2] and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    files, folder = Files(spark), f"{shared_folder(spark)}/pipeline-mine"
    assert [files.exists(f"{folder}/{k}") for k in range(3)] == [False, False, True]
    assert corpus_pipeline.run(spark, SF, "mine").count() == got.count() and len(calls) == 4


def brute_pipeline(docs, items):
    """The kept documents and their texts by the stages' rules, stage by stage, in plain Python over the operators' brute-force versions."""
    from test_decontamination import brute as decontaminated
    from test_line_operators import brute_base, brute_dedup, brute_line_fails
    from test_near_duplicates import brute as components

    kept = []
    for i, text in docs:
        lines = (text or "").split("\n")
        good = [x for x in lines if not brute_line_fails(x)]
        lost = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in lines if brute_line_fails(x))
        _, chars, *_, failed = brute_base(text)
        if not failed and lost <= 0.5 * chars:
            kept.append((i, text if len(good) == len(lines) else "\n".join(good)))
    kept = [(i, text) for i, text, *_ in brute_dedup(kept)]
    heads = {i for i, _, comp in components(kept) if i == comp}
    kept = [x for x in kept if x[0] in heads]
    bad = {i for i, *_, contaminated in decontaminated(kept, items) if contaminated}
    return {i: t for i, t in kept if i not in bad}


def test_run_as_brute_force(spark):
    """All stages together: which documents are left, and how many tokens each has."""
    from test_packing import ids

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_pipeline(docs, items)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(ids(t)) + 1 for i, t in want.items()}
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) + 1 for t in want.values())


def test_stages_take_odd_rows(spark, table, odd):
    for _, stage in corpus_pipeline.STAGES:
        for df in (table(odd), table([])):
            stage(spark, df, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_keep_all_rows(spark, name):
    table = "pages" if "op4" in name else "documents"
    key = "page_id" if "op4" in name else "doc_id"
    got = queries.QUERIES[name](spark, SF)
    assert got.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
