"""Sequence packing by non-negative least squares over a length histogram.

Documents become token ids with a separator, and are cut into windows.  What
remains of each, shorter than a window, is packed by plan: combinations of two
or three lengths that fill a window are enumerated, their repeat counts are
solved against the histogram of lengths, rounded, and carried out; the pieces
left over are packed greedily, cut where a window is full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from . import pretoken


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of present lengths that sum to window; a is 0 in pairs."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a, b = np.nonzero(np.triu(present[:, None] & present[None, :]))
    c = window - a - b
    triple = (c >= b) & present[np.clip(c, 0, window)]
    pair = a + b == window
    out = np.stack([a[triple], b[triple], c[triple]], 1)
    return np.concatenate([out, np.stack([0 * a[pair], a[pair], b[pair]], 1)]).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used close to the histogram: accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    used = lambda x: sum(np.bincount(combos[:, k], x, size) for k in range(3))
    target = histogram.astype(float)
    weight = np.ones(size)
    weight[0] = 0.0
    touch = used(np.ones(len(combos)))
    step = 1.0 / np.maximum(1.0, sum(touch[combos[:, k]] * (combos[:, k] > 0) for k in range(3)))
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = (used(y) - target) * weight
        new = np.maximum(0.0, y - step * (gap[combos[:, 0]] + gap[combos[:, 1]] + gap[combos[:, 2]]))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(sizes: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) for documents of sizes; every token lies in one piece.

    Whole windows of a document come first, then the solved combinations of
    remainders, then the greedy rest; only the last window may fall short.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest = sizes % window
    for d in np.flatnonzero(sizes >= window):
        out += [[(int(d), s, window)] for s in range(0, int(sizes[d] - rest[d]), window)]
    histogram = np.bincount(rest, minlength=window + 1)
    histogram[0] = 0
    order = np.argsort(rest, kind="stable")
    begin = np.searchsorted(rest[order], np.arange(window + 2))
    piles = {int(n): order[begin[n] : begin[n + 1]].tolist()[::-1] for n in np.flatnonzero(histogram)}

    def carry_out(combo: np.ndarray, times: int) -> int:
        """Windows made of a combination: as many as asked for, or as the piles allow."""
        parts = [int(n) for n in combo if n]
        for k in range(times):
            if any(len(piles[n]) < parts.count(n) for n in parts):
                return k
            out.append([(int(d), int(sizes[d] - n), n) for d, n in [(piles[n].pop(), n) for n in parts]])
            np.subtract.at(histogram, parts, 1)
        return times

    while True:  # solve, round, and solve again for what is left, until nothing rounds to a window
        combos = combinations(np.flatnonzero(histogram), window)
        counts = solve(combos, histogram)
        order_ = np.argsort(-counts, kind="stable")
        sure = order_[counts[order_] > 0.5]
        if not sum(carry_out(combos[k], round(counts[k])) for k in sure):
            break
    for k in order_[counts[order_] > 0]:  # then one of each that the solution holds a part of
        carry_out(combos[k], 1)
    row: list[tuple[int, int, int]] = []
    room = window
    for n in sorted(piles, reverse=True):
        for d in reversed(piles[n]):
            start, left = int(sizes[d] - n), n
            while left:
                take = min(left, room)
                row.append((int(d), start, take))
                start, left, room = start + take, left - take, room - take
                if not room:
                    out.append(row)
                    row, room = [], window
    if row:
        out.append(row)
    return out


def _packer(window: int, vocabulary: str | None, tokenizer: str | None, shard: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        encoder = pretoken.default_encoder(vocabulary, pretoken.added_tokens(tokenizer))
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        keys, parts, sizes, held = [], [], [], 0

        def flush():
            nonlocal serial
            ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            n = np.concatenate(sizes)
            base = np.cumsum(n) - n
            column = pa.concat_arrays(keys)
            rows = []
            for sequence in plan(n, window):
                offset = 0
                for d, s, m in sequence:
                    rows.append((d, s, m, base[d] + s, serial, offset))
                    offset += m
                serial += 1
            for lo in range(0, len(rows), 20000):
                t = np.array(rows[lo : lo + 20000], np.int64).reshape(-1, 6)
                own = [ids[p : p + m] for p, m in zip(t[:, 3].tolist(), t[:, 2].tolist())]
                cols = [column.take(pa.array(t[:, 0])), t[:, 1], t[:, 2], np.array([zlib.crc32(x) for x in own], np.int64), n[t[:, 0]], t[:, 4], t[:, 5]]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

        for batch in batches:
            for lo, hi, data, off in B.chunks(batch.column(1)):
                ids, n = encoder.encode(data, off)
                # the separator, id 0, ends each document
                padded = np.insert(ids, np.cumsum(n), 0).astype("<u4")
                key = batch.column(0).slice(lo, hi - lo)
                keys.append(key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key)
                parts.append(padded)
                sizes.append(n + 1)
                held += len(padded)
                if held >= shard:
                    yield from flush()
                    keys, parts, sizes, held = [], [], [], 0
        if keys:
            yield from flush()

    return run


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, tokenizer: str | None = None, shard_tokens: int = 12_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    docs: doc_id and text; other columns are ignored.  A null or empty text is
    the separator alone.  Ids are those of the tokenizer file with its added
    tokens: <|endoftext|> in a text is one id.  Repeated rows are packed as often as they occur; a
    null doc_id stays null.  An empty table gives no rows.

    Each partition is read once and nothing is shuffled.  A task packs shards of
    shard_tokens tokens, each by its own whole histogram, so its memory is
    bounded whatever its partition holds; at most the last sequence of a shard
    falls short.  A text longer than a shard is a shard of its own.  Sequence
    ids carry the partition's number: they are unique, and a repeated task
    writes the same ones.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_packer(window, vocabulary, tokenizer, shard_tokens, with_ids), schema)
