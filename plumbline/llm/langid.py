"""Language identification by multilingual mixture inference.

Byte n-grams of letters are counted per language.  For a document, expectation
maximisation estimates in which proportions the languages produced its n-grams;
a language is added to the set as long as the likelihood gained exceeds a
penalty that grows with the document's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as B

LETTER = re.compile(r"[^\W\d_]")

#: Bytes as n-grams see them: A-Z as a-z, everything of ASCII that is no letter as one blank.
SEEN = np.full(256, 32, np.uint8)
SEEN[97:123] = np.arange(97, 123)
SEEN[65:91] = np.arange(97, 123)
SEEN[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed n-gram, count) of the distinct n-grams of each text; n-grams of blanks alone are left out."""
    seen = SEEN[data].astype(np.uint64)
    n = len(seen) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = code * np.uint64(256) + seen[k : k + n]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    blank = np.uint64(int.from_bytes(b" " * size, "big"))
    whole = (owner[:n] == owner[size - 1 :]) & (code != blank)
    key = (code[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    both, count = np.unique((owner[:n][whole].astype(np.uint64) << np.uint64(bits)) | key, return_counts=True)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64), count.astype(float)


@dataclass
class Model:
    """log of each language's smoothed n-gram shares: logs[language, n-gram]."""

    languages: list[str]
    logs: np.ndarray
    size: int
    bits: int


def chosen(rows: DataFrame, n: int, most_rows: int) -> DataFrame:
    """About most_rows of n rows, each with the same chance; all of them if there are no more."""
    if n <= most_rows:
        return rows
    below = -(1 << 63) + (1 << 64) * most_rows // n  # of the 64-bit hashes
    return rows.where(F.xxhash64("text", F.monotonically_increasing_id()) < F.lit(below).cast("long"))


def fit(docs: DataFrame, size: int = 4, bits: int = 16, most_rows: int = 40_000) -> Model | None:
    """A model from rows of text and lang; None if there are none with both, as for an empty table.

    most_rows is the bound of the training sample: with more rows, each is taken
    with the chance most_rows / rows.  Repeated rows count as often as they occur.
    Counts are summed where the rows are; a language reaches the driver as one
    row of 2 ** bits numbers.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = chosen(rows, rows.count(), most_rows)

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, hi, data, off in B.chunks(batch.column(0)):
                owner, gram, c = grams(data, off, size, bits)
                of = np.array(names[lo:hi], object)
                for lang in set(of):
                    own = (of == lang)[owner]
                    tables.setdefault(lang, np.zeros(1 << bits))[:] += np.bincount(gram[own], c[own], 1 << bits)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "gram", "n"])

    def smoothed(own: pa.Table) -> pa.Table:
        table = np.full(1 << bits, 0.5)
        table[own.column("gram").to_numpy()] += own.column("n").to_numpy()
        return pa.table({"lang": own.column("lang")[:1], "logs": pa.array([np.log(table / table.sum()).astype("<f4").tobytes()])})

    totals = rows.mapInArrow(count, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sorted(totals.groupBy("lang").applyInArrow(smoothed, "lang string, logs binary").collect())
    if not found:
        return None
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["logs"], "<f4") for r in found]), size, bits)


def mixture(logs: np.ndarray, counts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of n-grams with rows of logs per language."""
    top = logs.max(0)
    p = np.exp(logs - top)
    share = np.full(len(logs), 1 / len(logs))
    total = counts.sum()
    for _ in range(rounds):
        each = share[:, None] * p
        share = (each / each.sum(0) @ counts) / total
    return share, float(np.log(share @ p) @ counts + top @ counts)


def _ordered(chosen: list[int], share: np.ndarray) -> tuple[list[int], np.ndarray]:
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


def infer(model: Model, gram: np.ndarray, counts: np.ndarray, penalty: float, most: int | None = None) -> tuple[list[int], np.ndarray]:
    """Languages of a document and their proportions, greatest first.

    n-grams overlap, so each stands for 1 / size of an observation.
    """
    logs = model.logs[:, gram].astype(float)
    counts = counts / model.size
    alone = logs @ counts
    chosen = [int(alone.argmax())]
    share, best = np.ones(1), float(alone.max())
    cost = penalty * np.log(max(counts.sum(), np.e))
    while len(chosen) < (len(logs) if most is None else min(most, len(logs))):
        # what a language could add at most: it takes over every n-gram that it explains better
        now = np.log(share @ np.exp(logs[chosen] - logs.max(0))) + logs.max(0)
        reach = np.maximum(logs - now, 0) @ counts
        reach[chosen] = -1
        for new in np.argsort(-reach, kind="stable").tolist():
            if reach[new] <= cost:
                return _ordered(chosen, share)
            trial, value = mixture(logs[chosen + [new]], counts)
            if value - best > cost:
                break
        else:
            return _ordered(chosen, share)
        chosen, share, best = chosen + [new], trial, value
    return _ordered(chosen, share)


def predict(docs: DataFrame, model: Model | None, penalty: float = 4.0, most: int | None = None) -> DataFrame:
    """docs with lang_pred, score and langs (array of language and share).

    lang_pred is the language of the greatest proportion, score that proportion.
    A text that is null or has no letter is `und` with score 0, and so is every
    text where there is no model.  most bounds the languages of a text, where it
    is given; otherwise all may be among them.  Columns of docs with one of these
    names are replaced, others pass through.  Rows are judged one by one without
    a shuffle, repeated ones alike; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "langs").withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # languages x 2 ** bits floats, whatever the corpus

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            for lo, hi, data, off in B.chunks(texts, 1 << 19):
                own = batch.slice(lo, hi - lo)
                found = [[] for _ in range(hi - lo)]
                if model is not None:
                    owner, gram, counts = grams(data, off, model.size, model.bits)
                    cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                    for i, text in enumerate(own.column(at).to_pylist()):
                        if text is None or not LETTER.search(text):
                            continue
                        a, b = cut[i], cut[i + 1]
                        if a == b:  # shorter than an n-gram: the n-grams of the text between blanks
                            _, g, c = grams(np.frombuffer(b" " + text.encode() + b" " * model.size, np.uint8), np.array([0, len(text.encode()) + 1 + model.size]), model.size, model.bits)
                        else:
                            g, c = gram[a:b], counts[a:b]
                        if len(g):
                            langs, share = infer(model, g, c, penalty, most)
                            found[i] = [{"lang": model.languages[k], "share": float(s)} for k, s in zip(langs, share)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([x[0]["lang"] if x else "und" for x in found], pa.string()), pa.array([min(1.0, x[0]["share"]) if x else 0.0 for x in found], pa.float64()), pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=[*own.schema.names, "lang_pred", "score", "langs"],
                )

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema.add("langs", T.ArrayType(T.StructType().add("lang", "string").add("share", "double"))))
