import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bytewords, editcount, packing, pretoken

ENCODER = pretoken.default_encoder(added=pretoken.added_tokens())
EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def encoded(texts):
    out = []
    for lo, hi, data, off in bytewords.chunks(pa.array(texts, pa.string()), 64):
        all_ids, n = ENCODER.encode(data, off)
        out += [x.tolist() for x in np.split(all_ids, np.cumsum(n)[:-1])]
    return out


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "a", "B", "é", "ß", "1", "²", "½", ".", "!", "<|endoftext|>", "''", "_", "\r\n", "中", "я", "😀", "‍", "ก", "　", "Ⅷ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30), min_size=1, max_size=6))
def test_ids_are_those_of_tokenizers(texts):
    assert encoded(texts) == [ids(t) for t in texts]


def morse(a, b, n=1024):
    """The Thue-Morse word over two strings, on which polynomial hashes modulo 2 ** 64 collide."""
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_pretokens_are_compared():
    a, b = morse("a", "b"), morse("b", "a")
    assert encoded([a, b, b + a]) == [ids(a), ids(b), ids(b + a)]
    small = pretoken.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, slots=4, most_entries=50)
    rng = random.Random(3)
    for _ in range(60):  # every slot is fought for, and the cache is emptied again and again
        texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(60))) for _ in range(5)]
        for _, _, data, off in bytewords.chunks(pa.array(texts)):
            got, n = small.encode(data, off)
            assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [ids(t) for t in texts]


def test_added_tokens():
    assert ids("a<|endoftext|>b") == [64, 50256, 65]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x", " <|endoftext|> <|endoftext|>é中<|endof", ""]
    assert encoded(texts) == [ids(t) for t in texts]


def test_round_trip(table, odd):
    rng = random.Random(2)
    pairs = odd[:4] + odd[5:12] + [(100 + k, " ".join(rng.choice(["alpha", "Beta", "γάμμα", "don't", "12"]) for _ in range(rng.choice([1, 30, 400, 2500])))) for k in range(60)]
    rows = packing.pack(table(pairs, clash=True), with_ids=True).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) >= 1 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    unique = {i: t for i, t in pairs if i is not None}
    for i, t in unique.items():
        want = [*ids(t or ""), 0]
        got = [x for r in sorted(whole[(i, len(want))], key=lambda r: r["start"]) for x in r["ids"]]
        assert got == want
    tokens = sum(r["length"] for r in rows)
    assert tokens == sum(len(ids(t or "")) + 1 for _, t in pairs)
    assert len(sequences) * 1024 - tokens <= 3 * 1024  # one short sequence a partition
    assert packing.pack(table([])).count() == 0


def test_shards_bound_memory_without_loss(table):
    pairs = [(k, "word " * (37 * k % 300 + 1)) for k in range(80)]
    a = packing.pack(table(pairs, parts=1), shard_tokens=2000).collect()
    assert sum(r["length"] for r in a) == sum(len(ids(t)) + 1 for _, t in pairs)
    assert len({(r["doc_id"], r["start"]) for r in a}) == len(a)


def test_plan_uses_solved_combinations():
    rng = np.random.default_rng(0)
    sizes = rng.choice([100, 300, 624, 512, 700, 324], 600)
    plan = packing.plan(sizes, 1024)
    assert sorted((d, s) for row in plan for d, s, _ in row)[::1] and sum(n for row in plan for *_, n in row) == sizes.sum()
    whole = [row for row in plan if sum(n for *_, n in row) == 1024]
    assert len(whole) >= len(plan) - 1
    assert sum(all(s == 0 for _, s, _ in row) for row in plan) > 0.5 * len(plan)  # most are packed uncut
    combos = packing.combinations(np.array([100, 300, 624, 512, 700, 324]), 1024)
    assert {tuple(c) for c in combos} == {(0, 512, 512), (0, 324, 700), (100, 300, 624), (300, 100, 624)} - {(300, 100, 624)} | {tuple(c) for c in combos if sum(c) == 1024}
    x = packing.solve(combos, np.bincount([512, 512, 324, 700], minlength=1025))
    assert x.min() >= 0 and abs(x[[tuple(c) for c in combos].index((0, 324, 700))] - 1) < 0.1


@pytest.mark.parametrize("edits", [[], [(0, 0, "New start. ")], [(5, 9, "")], [(3, 3, "'s"), (10, 400, "x"), (-5, 2, "é"), (9999, 9999, " end")]])
def test_edited_counts(table, odd, edits):
    from pyspark.sql import functions as F

    given_ = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("new")) for a, b, c in edits]) if edits else F.lit(None)
    for r in editcount.count_edits(table(odd, clash=True).withColumn("edits", given_)).collect():
        assert r["n_reencoded"] <= 60 * len(edits) or r["n_reencoded"] <= r["pretokens_after"] * len(edits)
    df = table(odd).withColumn("edits", given_)
    want = []
    for i, t in odd:
        t = now = t or ""
        for a, b, c in edits:
            a = min(max(a, 0), len(now))
            b = min(max(b, a), len(now))
            now = now[:a] + c + now[b:]
        want.append((i, len(ids(t)), len(ids(now)), len(now)))
    got = [(r["doc_id"], r["n_tokens"], r["tokens_after"], r["edited_chars"]) for r in editcount.count_edits(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trees_go_on(table, odd):
    """A second batch of edits on kept trees gives what all edits at once give, without cutting the texts again."""
    from pyspark.sql import functions as F

    def edit(a, b, c):
        return F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("new")))

    df = table(odd[:8], clash=True).withColumn("edits", edit(3, 9, "Some words. "))
    first = editcount.count_edits(df, keep=True)
    again = first.select("doc_id", F.col("text_after").alias("text"), F.col("tree_after").alias("tree"), edit(0, 1, "x y").alias("edits"))
    columns = ["doc_id", "tokens_after", "pretokens_after", "edited_chars"]
    got = sorted(map(tuple, editcount.count_edits(again, tree="tree").select(columns).collect()), key=repr)
    assert got == sorted(map(tuple, editcount.count_edits(again.drop("tree")).select(columns).collect()), key=repr)
    cheat = again.withColumn("tree", F.when(F.col("doc_id") != 2, F.struct(F.array(F.length("text")).alias("lengths"), F.array(F.lit(7)).alias("counts"))))
    assert all((r["n_tokens"] == 7) == (r["doc_id"] != 2) for r in editcount.count_edits(cheat, tree="tree").collect())


def test_edit_tree_random():
    import regex

    pattern, encode = regex.compile(public_tokenizers.PATTERN), ENCODER.whole.encode_ordinary
    count = lambda s: len(encode(s))
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 40, 400])))
        found = pattern.findall(t)
        tree = editcount.CountTree(list(map(len, found)), list(map(count, found)))
        for _ in range(3):
            a = rng.randint(0, len(t))
            b = min(len(t), a + rng.choice([0, 1, 2, 5, 100]))
            t, _ = editcount.apply_edit(t, tree, a, b, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 6, 60]))), pattern, count)
            found = pattern.findall(t)
            assert [x for block in tree.blocks for x in block[0]] == list(map(len, found))
            assert tree.tokens == len(encode(t)) and tree.length == len(t)
            levels = [list(x) for x in tree.levels]
            tree._sum_up()
            assert levels == tree.levels
