import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(pairs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in pairs:
        w = words(t)
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    ids |= found
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in ids if x is not None)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df, items, **kw):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in decontam.decontaminate(df, items, **kw).collect()), key=repr)


def data(seed):
    rng = random.Random(seed)
    vocabulary = "the of and é中 river road X9 it's".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 12, 13, 14, 30]))) for k in (1, 2, 10, 30, 30)] + [(5, None), (6, ""), (7, "?!"), (None, text(20))]
    pairs = []
    for k in range(40):
        body = text(rng.choice([0, 3, 20, 200]))
        if rng.random() < 0.5:
            body += rng.choice([". ", "\n", "--"]) + (rng.choice(items)[1] or "").upper().replace(" ", ", ")
        pairs.append((k, body + " " + text(5)))
    return pairs, items


@pytest.mark.parametrize("bound, told", [(100_000, 10**7), (40, 0)], ids=["one block, broadcast", "blocks, shuffle"])
def test_as_brute_force(spark, table, odd, bound, told):
    items_schema = "item_id long, text string"
    for pairs, items in (data(1), (odd, [(1, odd[4][1]), (2, "the quick brown fox jumps over the lazy dog other words stand here")])):
        got = result(table(pairs, clash=True), spark.createDataFrame(items, items_schema), most_windows=bound, told_bytes=told)
        assert got == brute(pairs, items)
    none = spark.createDataFrame([], items_schema)
    assert result(table(odd), none) == brute(odd, [])
    assert result(table([]), none) == []


def test_clean_text(spark, table):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = decontam.decontaminate(table([(1, f"Before it. {item.upper()}; After it.")]), items).first()
    assert r["clean_text"] == "Before it. After it." and r["contaminated"] and r["n_hit"] == 14
    long = "word " * 400
    r = decontam.decontaminate(table([(1, long + item)]), items).first()
    assert not r["contaminated"] and r["n_hit"] == 14


def test_native(spark, table):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.decontaminate(table([(1, "a b c")]), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


@pytest.mark.parametrize("most", [1000, 1])
def test_hits_of_equal_hashes_are_verified(spark, table, monkeypatch, most):
    real = decontam.benchmark_windows
    collide = lambda benchmark, size: real(benchmark, size).withColumn("window", F.when(F.col("item_id") == "1", "other words").otherwise(F.col("window")))
    monkeypatch.setattr(decontam, "benchmark_windows", collide)
    items = spark.createDataFrame([(1, "red stone bridge"), (2, "old green river"), (None, "a quiet town")], "item_id long, text string")
    pairs = [(1, "the red stone bridge stands"), (2, "an old green river runs"), (3, "once a quiet town slept")]
    assert result(table(pairs), items, most_windows=most) == [(1, 5, 0, (), False), (2, 5, 3, ("2",), True), (3, 5, 3, (), True)]
