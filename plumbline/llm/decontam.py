"""Benchmark decontamination by a hash set of word windows; DataFrame functions only.

The hashes of the benchmark's windows are told to all tasks.  A text's words are
hashed, the hashes of its windows are held against that set where the text lies,
and hits are verified word by word.  Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import meeting, saved
from .linededup import folded

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GLUE = " "  # no word contains it


def words_of(text: str = "text") -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(folded(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once although body is a function that loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, size: int) -> Column:
    """The hash of each window of size words, by its start (from 0); null for fewer words."""
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, size))))


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (hash, width, window, item_id); an item of fewer words than size, but some, is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).where(F.size("words") > 0)
    width = F.least(F.lit(size), F.size("words"))
    cut = items.select("item_id", width.alias("width"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.slice("words", i, width))).alias("words"))
    return cut.select(F.xxhash64(word_hashes(F.col("words"))).alias("hash"), "width", F.array_join("words", GLUE).alias("window"), "item_id").distinct()


def _near(docs: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, row, start, hash, width, window) of the windows of docs whose hash is known."""
    words = docs.select(*_key(), words_of().alias("__plumb_words"))
    hashed = words.select("*", word_hashes(F.col("__plumb_words")).alias("__plumb_h"))
    by_width = F.array(*[F.struct(F.lit(w).alias("width"), window_hashes(F.col("__plumb_h"), w).alias("hashes")) for w in widths])
    cut = hashed.select("__plumb_doc", "__plumb_row", "__plumb_words", F.explode(by_width).alias("x"))
    places = cut.select("__plumb_doc", "__plumb_row", "__plumb_words", "x.width", F.posexplode("x.hashes").alias("start", "hash"))
    met = places.join(F.broadcast(known), "hash", "left_semi")
    return met.select("__plumb_doc", "__plumb_row", (F.col("start") + 1).alias("start"), "hash", "width", F.array_join(F.slice("__plumb_words", F.col("start") + 1, F.col("width")), GLUE).alias("window"))


def _key() -> list[Column]:
    return [F.col("doc_id").alias("__plumb_doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__plumb_row")]


def _hits(docs: DataFrame, windows: DataFrame, most_windows: int) -> DataFrame:
    """(doc, row, __plumb_hit, __plumb_items) of the rows with verified hits: places of words hit, from 1, and the items' ids."""
    hashes = windows.select("hash").distinct()
    blocks = -(-hashes.count() // most_windows)
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    near = None
    for k in range(blocks):
        own = _near(docs, hashes.where(F.pmod("hash", F.lit(blocks)) == k) if blocks > 1 else hashes, widths)
        near = own if near is None else near.union(own)
    near = saved(near)
    same = ["hash", "width", "window"]
    met = near.groupBy(same).agg(F.count("*").alias("size"))
    items = saved(met.join(windows.groupBy(same).agg(F.collect_set("item_id").alias("items")), same))
    total = items.agg(F.sum("size")).first()[0] or 0
    hits = meeting(near, items, same, total, F.xxhash64("__plumb_doc", "__plumb_row", "start"))
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("width") - 1))))
    return hits.groupBy("__plumb_doc", "__plumb_row").agg(places.alias("__plumb_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__plumb_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, most_windows: int = 1_000_000, told_bytes: int = 16_000_000) -> DataFrame:
    """docs' rows and columns with n_words, n_hit, item_ids (array), contaminated and clean_text.

    A window is `size` consecutive words of a benchmark item, or all of a
    shorter one.  A word of docs inside an occurrence of a window is hit;
    item_ids are those of the items whose windows occur, sorted as strings.
    contaminated: some word is hit, and at least one word of `share`.  clean_text
    is the text without the hit words and what follows each of them up to the
    next word.

    Null and empty texts have no words and are clean; null item_ids count for
    hits but are not listed.  Columns of docs with one of the new names are
    replaced; rows are neither lost nor merged.

    A task is told most_windows hashes at a time, 100 bytes each at most.  A larger
    benchmark goes in blocks of so many, each with a pass over docs; the hits of
    all are put together.  The rows with hits meet docs by broadcast where their
    positions and ids, which are counted first, take told_bytes at most, and by
    shuffle beyond.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated", "clean_text")
    windows = saved(benchmark_windows(benchmark, size))
    no_places, no_ids = F.array().cast("array<int>"), F.array().cast("array<string>")
    if windows.isEmpty():
        found = docs.withColumns({"__plumb_hit": no_places, "__plumb_items": no_ids})
    else:
        hits = saved(_hits(docs, windows, most_windows))
        weight = hits.agg(F.sum(64 + 4 * F.size("__plumb_hit") + F.length(F.array_join("__plumb_items", ",")))).first()[0] or 0
        rows = docs.withColumn("__plumb_hash", _key()[1])
        found = rows.join(F.broadcast(hits) if weight <= told_bytes else hits, F.col("doc_id").eqNullSafe(F.col("__plumb_doc")) & (F.col("__plumb_hash") == F.col("__plumb_row")), "left")
    words = words_of()
    hit = F.coalesce("__plumb_hit", no_places)
    n_words, n_hit = F.size(words).cast("long"), F.size(hit).cast("long")
    found = found.select(*[F.col(f"`{c}`") for c in docs.columns], n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("__plumb_items", no_ids).alias("item_ids"), hit.alias("__plumb_hit"))
    text = F.col("text").cast("string")
    pieces = bound(F.split(text, WORD_ANY_CASE, -1), lambda gaps: bound(
        F.regexp_extract_all(text, F.lit(f"({WORD_ANY_CASE})"), F.lit(1)),
        lambda own: F.concat(F.element_at(gaps, 1), F.array_join(F.filter(F.transform(own, lambda w, i: F.when(~F.array_contains("__plumb_hit", i + 1), F.concat(w, F.element_at(gaps, i + 2)))), lambda x: x.isNotNull()), ""))))
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", "n_hit", "item_ids",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.when(F.col("n_hit") > 0, pieces).otherwise(text).alias("clean_text"),
    )


WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
