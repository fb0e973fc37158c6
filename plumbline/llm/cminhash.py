"""Near-duplicate classes by circulant MinHash.

Two permutations make every signature coordinate: the first scatters the
shingles over a ring of 2**32 places, the second, turned by k places, orders
the ring for coordinate k.  Bands of coordinates give candidate buckets; every
link is confirmed by the exact Jaccard similarity of the full shingle sets.

Candidates are never expanded into the pairs of a bucket.  Texts with equal
sets are one class from the start.  Each class is compared with the least
member of its buckets; classes joined that way are merged.  Where a bucket still
spans components after that, its members outside the largest of them are
compared with all its members, in blocks, by signatures; texts move only for
those that signatures leave, and only links leave the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .components import components, meeting, merged, of_components, saved

U32 = np.uint32
TURN = 0x3C6EF35F  # places by which the second permutation turns from one coordinate to the next


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation: 64-bit shingle hashes to places on the ring."""
    return (x >> np.uint64(32)).astype(U32) ^ x.astype(U32)


def order(place: np.ndarray, shift: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Second permutation, turned by shift, of places; a and b are room for the result."""
    np.subtract(place, U32(shift & 0xFFFFFFFF), out=a)
    np.multiply(a, U32(0x7FEB352D), out=a)
    np.right_shift(a, U32(15), out=b)
    np.bitwise_xor(a, b, out=a)
    np.multiply(a, U32(0x846CA68B), out=a)
    np.right_shift(a, U32(16), out=b)
    np.bitwise_xor(a, b, out=a)
    return a


def signatures(places: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """(sets, size) least places in each turned order; set i is places[begin[i]:begin[i + 1]], none is empty."""
    out = np.empty((len(begin) - 1, size), U32)
    lo = 0
    while lo < len(begin) - 1:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + 32768, "right")) - 1)
        own = places[begin[lo] : begin[hi]]
        cut = begin[lo:hi] - begin[lo]
        a, b = np.empty_like(own), np.empty_like(own)
        for k in range(size):
            out[lo:hi, k] = np.minimum.reduceat(order(own, k * TURN, a, b), cut)
        lo = hi
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `words` words, A-Z lower-cased; of fewer words, all as one."""
    starts, ends, owner = B.spans(~B.IS_SPACE[data], off)
    h = B.hashes(B.LOWER[data], starts, ends)
    runs, first = B.windows(h, owner, words)
    begin = np.searchsorted(owner, np.arange(len(off)))
    cut = np.searchsorted(first, begin)
    out = []
    for i in range(len(off) - 1):
        n = begin[i + 1] - begin[i]
        if n >= words:
            out.append(np.unique(runs[cut[i] : cut[i + 1]]))
        elif n:
            out.append(B.windows(h[begin[i] : begin[i + 1]], owner[begin[i] : begin[i + 1]], int(n))[0] ^ B.U64(int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signer(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.chunks(batch.column(1)):
                sets = shingle_sets(data, off, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                begin = np.concatenate([[0], np.cumsum(sizes[full])])
                places = scatter(np.concatenate([sets[i] for i in full])) if len(full) else np.zeros(0, U32)
                sig = signatures(places, begin, bands * rows)
                key = np.zeros((len(full), bands), np.uint64)
                for k in range(rows):
                    key = B.mix(key * B.U64(0x9E3779B97F4A7C15) + sig[:, k::rows])
                key = B.mix(key + np.arange(bands, dtype=np.uint64) * B.U64(0xD1B54A32D192ED03)).view(np.int64)
                where = np.cumsum(sizes > 0) - 1
                some = (sizes > 0).tolist()
                digest = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                n_keys = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
                small = sig.astype(np.uint8)
                marks = [small[where[i]].tobytes() if some[i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(n_keys), pa.array(key.ravel()))],
                    names=["doc_id", "n_shingles", "digest", "mark", "keys"],
                )

    return run


def _confirmer(words: int, percent: int):
    """Rows sorted by (b, salt, tag): b's text comes first, then the texts to hold against it."""

    def run(batches):
        now, leaders = None, []
        for batch in batches:
            found = []
            for lo, hi, data, off in B.chunks(batch.column(4)):
                sets = shingle_sets(data, off, words)
                rows = zip(*(batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(4)), sets)
                for b, salt, tag, a, own in rows:
                    if (b, salt) != now:
                        now, leaders = (b, salt), []
                    if tag == 0:
                        leaders.append(own)
                        continue
                    for x in leaders:
                        both = len(np.intersect1d(x, own, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(own) - both):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, salts: int = 64) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    b's text is sent once to each of up to `salts` groups of its partners, so a
    text with very many partners is spread over tasks; a's text goes with the pair.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int").alias("salt"))
    lead = pairs.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("a"), F.col("b").alias("doc_id"))
    both = lead.union(pairs.select("b", "salt", F.lit(1), "a", F.col("a").alias("doc_id"))).join(docs.select("doc_id", "text"), "doc_id").drop("doc_id")
    return both.repartition("b", "salt").sortWithinPartitions("b", "salt", "tag").mapInArrow(_confirmer(words, percent), "a long, b long")


def _strangers(percent: int, least: int):
    """Rows sorted by (bucket, part, side): those members and strangers of the part that could be linked with one another.

    side 0: strangers, the bucket's members outside its largest component, all of
    one block of them; side 1: members of the part.  A pair counts if it is of
    different components, if sizes and signatures allow a link, and if this is
    the least of the buckets that both are in.
    """

    def block(rows):
        ids, sizes, comps = (np.array([x[k] for x in rows], np.int64) for k in (0, 2, 3))
        return ids, sizes, comps, np.frombuffer(b"".join(x[1] for x in rows), np.uint8).reshape(len(rows), -1)

    def ends(bucket, strangers, members):
        out = set()
        if strangers and members:
            ids, sizes, comps, marks = block(members)
            held = [set(x[4]) for x in members]
            for doc, mark, n, comp, keys in strangers:
                like = np.flatnonzero((comps != comp) & (100 * sizes >= percent * n) & (percent * sizes <= 100 * n))
                for j in like[(marks[like] == np.frombuffer(mark, np.uint8)).sum(1) >= least].tolist():
                    if min(held[j].intersection(keys)) == bucket:
                        out.update((doc, int(ids[j])))
        return out

    def run(batches):
        now, strangers, members = None, [], []
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["key", "part", "doc_id"])
        for batch in batches:
            found = []
            for bucket, part, side, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, part) != now:
                    found += [(*now, x) for x in ends(now[0], strangers, members)] if now else []
                    now, strangers, members = (bucket, part), [], []
                (members if side else strangers).append(member)
            yield rows(found)
        yield rows([(*now, x) for x in ends(now[0], strangers, members)] if now else [])

    return run


def _linker(words: int, percent: int):
    """Rows sorted by (bucket, part): links (a, b), a > b, by full sets that join the components there; only links leave the task."""

    def links(rows):
        sets = [x for _, _, data, off in B.chunks(pa.array([r[2] for r in rows], pa.string())) for x in shingle_sets(data, off, words)]
        sizes = np.array([len(x) for x in sets])
        comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        by_value = np.argsort(flat, kind="stable")
        flat, owner = flat[by_value], owner[by_value]
        for i in np.argsort(-sizes, kind="stable").tolist():
            apart = comp != comp[i]
            if not apart.any():
                continue
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            stop = np.cumsum(n)
            both = np.bincount(owner[np.repeat(lo - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)], minlength=len(sets))
            for j in np.flatnonzero(apart & (both > 0) & (100 * both >= percent * (sizes + sizes[i] - both))).tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    yield max(rows[i][0], rows[j][0]), min(rows[i][0], rows[j][0])

    def run(batches):
        now, held = None, []
        out = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])
        for batch in batches:
            found = []
            for bucket, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, part) != now:
                    found += links(held) if held else []
                    now, held = (bucket, part), []
                held.append(row)
            yield out(found)
        yield out(list(links(held)) if held else [])

    return run


def _far_links(docs: DataFrame, crowd: DataFrame, marks: DataFrame, joined: DataFrame, words: int, percent: int, least: int, block: int) -> DataFrame:
    """Links (a, b), a > b, of members of one bucket that are in different components.

    Buckets of the same members are one.  A bucket's members are dealt over
    parts of about `block`; its strangers, the members outside its largest
    component, are dealt likewise, and each block of them goes to every part.  So
    the work is the number of strangers times the number of members, and no task
    holds more than two blocks.  Signatures go to those buckets alone that span
    components, texts only for members that signatures leave, once a part.
    """
    placed = crowd.join(joined, "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most")).where("most < size")
    mixed = saved(mixed.select("key", "main", "size", (F.col("size") / block).cast("int").alias("last"), ((F.col("size") - F.col("most")) / block).cast("int").alias("far")))
    total = mixed.agg(F.sum("size")).first()[0] or 0
    rows = saved(meeting(placed, mixed, ["key"], total, F.xxhash64("doc_id")))
    who = rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).join(marks, "doc_id")  # as many keys as bands at most
    rows = rows.join(who, "doc_id")
    deal = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n) + 1).cast("int")
    part = lambda far, near: F.struct(far.alias("far"), near.alias("near"))
    here, there, each = deal("last", 1), deal("far", 2), ("doc_id", "mark", "n", "comp", "keys")
    member = rows.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("far")), lambda f: part(f, here))).alias("part"), F.lit(1).alias("side"), *each)
    stranger = rows.where("comp <> main").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda m: part(there, m))).alias("part"), F.lit(0).alias("side"), *each)
    cells = member.union(stranger).withColumn("part", F.col("part.far") * F.lit(1 << 32).cast("long") + F.col("part.near"))
    left = saved(cells.repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(_strangers(percent, least), "key long, part long, doc_id long"))
    texts = _few(left.select("doc_id").distinct(), docs).select("doc_id", "text")
    comps = joined.withColumnRenamed("component_id", "comp")
    held = left.join(comps, "doc_id", "left").join(texts, "doc_id").select("key", "part", "doc_id", F.coalesce("comp", "doc_id").alias("comp"), "text")
    return held.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_linker(words, percent), "a long, b long").distinct()


def _few(ids: DataFrame, docs: DataFrame, told: int = 100_000) -> DataFrame:
    """docs of these ids; where there are no more than `told`, a checked size, they are picked out where they lie."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.limit(told + 1).count() <= told else docs


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 40, rows: int = 5, block: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id that can be reached).

    docs: doc_id (an integer) and text; other columns are ignored.  A null text
    or one without words has an empty set and is linked with nothing.  Rows
    with a null doc_id cannot be named by others: they are linked with nothing
    and their component_id is null.  Rows that repeat a doc_id share its
    component.  An empty table gives no rows.

    bands x rows coordinates find a pair at the threshold 0.75 with a chance of
    1 - (1 - 0.75 ** 5) ** 40, all but 2 in 100,000, and more similar pairs more
    surely still.  No bucket is capped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = saved(docs.mapInArrow(_signer(words, bands, rows), "doc_id long, n_shingles long, digest binary, mark binary, keys array<long>"))
    usable = signed.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    shared = saved(classes.where("size > 1"))
    n_shared = shared.agg(F.sum("size")).first()[0] or 0
    of_class = saved(meeting(usable.select("doc_id", "digest"), shared, ["digest"], n_shared, F.xxhash64("doc_id")).select("doc_id", "digest", "rep").distinct())
    heads = usable.select("doc_id", "digest", "keys").join(of_class.where("doc_id <> rep").select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    members = heads.dropDuplicates(["doc_id", "digest"]).select("doc_id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("who")).where("size > 1")
    # buckets of the same members are one
    buckets = saved(buckets.groupBy("low", "size", "who").agg(F.min("key").alias("key")).select("key", "low", "size"))
    n_crowd = buckets.agg(F.sum("size")).first()[0] or 0
    crowd = saved(meeting(members, buckets, ["key"], n_crowd, F.xxhash64("doc_id")).select("key", "doc_id", "low"))
    marks = usable.select("doc_id", "mark", F.col("n_shingles").alias("n"))
    # the bound lies 5.3 standard deviations below what a pair at the threshold has on average
    coordinates, share = bands * rows, percent / 100
    least = int(coordinates * share - 5.3 * (coordinates * share * (1 - share)) ** 0.5)

    # Each member against the least of its buckets: first the one it meets most often, then the others it is not joined with.
    stars = saved(crowd.where("doc_id <> low").groupBy(F.col("doc_id").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("meets")))
    best = saved(stars.groupBy("a").agg(F.max_by("b", F.struct("meets", -F.col("b"))).alias("b")))
    # a doc_id with several texts joins their classes
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    own = of_class.join(several, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = saved(components(confirmed(best, docs, words, percent).union(own)))  # the one time that all texts move
    pairs = saved(_plausible(_across(stars.select("a", "b"), joined), marks, least, percent))
    joined = _joined(joined, confirmed(pairs, _few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs), words, percent))
    joined = _joined(joined, _far_links(docs, crowd, marks, joined, words, percent, least, block))
    rep_of = of_class.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    roots = rep_of.join(joined.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    alone = joined.join(of_class, "doc_id", "left_anti")
    return signed.select("doc_id", "n_shingles").join(roots.union(alone), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(joined: DataFrame, links: DataFrame) -> DataFrame:
    """joined after these links."""
    links = saved(links)
    return joined if links.isEmpty() else saved(merged(joined, links))


def _across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    return of_components(pairs, joined).where("comp_a <> comp_b").select("a", "b")


def _agree(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).sum(1).astype(np.int64))], names=["a", "b", "agree"])


def _plausible(pairs: DataFrame, marks: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    a = marks.select(F.col("doc_id").alias("a"), F.col("mark").alias("mark_a"), F.col("n").alias("n_a"))
    b = marks.select(F.col("doc_id").alias("b"), F.col("mark").alias("mark_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return both.select("a", "b", "mark_a", "mark_b").mapInArrow(_agree, "a long, b long, agree long").where(F.col("agree") >= least).select("a", "b").distinct()
