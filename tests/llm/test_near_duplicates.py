import random
import re

import numpy as np
import pytest

from plumbline.llm import bytewords, cminhash
from plumbline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and i != j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in cminhash.near_duplicates(df).collect()), key=repr)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    common = " ".join(rng.choice(vocabulary) for _ in range(60))
    out, k = [], 0
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 80, 300]))]
        for copies in range(rng.choice([1, 2, 5, 12])):
            k += 1
            out.append((rng.randrange(10**6), " ".join(words).upper() if copies % 3 == 1 else edited(rng, words, rng.randrange(0, 1 + len(words) // 25))))
    for _ in range(40):  # unlike texts with one long passage in common
        out.append((rng.randrange(10**6), common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 18, 40])))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(table, seed):
    pairs = corpus(seed)
    assert result(table(pairs)) == brute(pairs)


def test_odd_rows(table, odd):
    assert result(table(odd, clash=True)) == brute(odd)
    assert result(table([])) == []
    assert result(table([(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


def test_words_of_equal_sums(table):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    pairs = [(1, a), (2, b), (3, f"{a} one two three four"), (4, f"{b} one two three four")]
    assert result(table(pairs)) == brute(pairs) == [(i, 1, i) for i in range(1, 5)]


def test_signatures_are_two_permutations(table):
    place = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    a, b = np.empty_like(place), np.empty_like(place)
    assert len(np.unique(cminhash.order(place, 5 * cminhash.TURN, a, b))) == len(place)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    both = np.concatenate([x[:3000], y[:500]]), x[:4000]
    sig = [cminhash.signatures(cminhash.scatter(bytewords.mix(s)), np.array([0, len(s)]), 400)[0] for s in both]
    assert abs((sig[0] == sig[1]).mean() - 3000 / 4500) < 0.08


def test_strangers_meet_all_members():
    """Members outside the largest component of a bucket are held against all its members; signatures, sizes and the least common bucket choose."""
    import pyarrow as pa

    names = ["key", "part", "side", "doc", "mark", "n", "comp", "keys"]
    marks = {1: b"abcd", 2: b"abcd", 3: b"abcx", 4: b"wxyz", 5: b"abcd", 6: b"abcd"}
    n, comp = {1: 40, 2: 40, 3: 40, 4: 40, 5: 90, 6: 40}, {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}
    keys = {1: [9, 11], 2: [9], 3: [9, 8], 4: [9], 5: [9], 6: [8, 9]}
    cells = [(9, 0, 0, d) for d in (3, 4, 5)] + [(9, 0, 1, d) for d in (1, 2, 3, 4, 5, 6)] + [(9, 1, 1, 1), (9, 2, 0, 3), (9, 2, 1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, p, s, d, marks[d], n[d], comp[d], keys[d]) for k, p, s, d in cells])], names=names)
    found = [(x["key"], x["part"], x["doc_id"]) for b in cminhash._strangers(75, 3)(iter([batch.slice(0, 4), batch.slice(4)])) for x in b.to_pylist()]
    assert sorted(found) == [(9, 0, 1), (9, 0, 2), (9, 0, 3), (9, 2, 2), (9, 2, 3)]  # 3 and 6 meet in bucket 8


def test_links_join_components():
    import pyarrow as pa

    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join([*base[:36], "y"]), " ".join(f"z{i}" for i in range(40)), " ".join([*base[:20], *[f"q{i}" for i in range(20)]])]
    batch = pa.RecordBatch.from_arrays([pa.array([9] * 5), pa.array([0] * 5), pa.array([1, 2, 3, 4, 5]), pa.array([1, 2, 3, 4, 5]), pa.array(texts)], names=["key", "part", "doc_id", "comp", "text"])
    found = {(x["a"], x["b"]) for b in cminhash._linker(5, 75)(iter([batch])) for x in b.to_pylist()}
    linked = {(j + 1, i + 1) for j in range(5) for i in range(j) if 100 * len(shingles(texts[i]) & shingles(texts[j])) >= 75 * len(shingles(texts[i]) | shingles(texts[j]))}
    assert linked == {(2, 1), (3, 1), (3, 2)} and found <= linked and len(found) == 2


@pytest.mark.parametrize("block", [512, 3])
def test_bucket_of_several_components(spark, table, block):
    """Texts whose nearest ones are not the least of any bucket; blocks of three are many."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    pairs = []
    for k in range(14):  # a chain: each differs from the one before by a little, from the first by a lot
        base = [*base[2:], rng.choice(vocabulary), rng.choice(vocabulary)]
        pairs += [(rng.randrange(10**6), " ".join(base)), (rng.randrange(10**6), " ".join([*base, "end"]))]
    pairs += [(5, pairs[0][1]), (5, pairs[-1][1]), (5, pairs[-1][1])]  # one id, two texts
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in cminhash.near_duplicates(table(pairs), block=block).collect()), key=repr)
    assert got == brute(pairs)


def test_meeting_deals_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from plumbline.llm import components as C

    monkeypatch.setattr(C, "HOT", 5)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 100, k) for k in range(90)] + [(None, 1)], "key long, doc_id long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("doc_id").alias("top")).where("key > 2")
    got = sorted(map(tuple, C.meeting(rows, sizes, ["key"], 90, F.xxhash64("doc_id")).select("key", "doc_id", "top").collect()))
    assert got == sorted(map(tuple, rows.join(sizes, "key").select("key", "doc_id", "top").collect()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(5, None)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
