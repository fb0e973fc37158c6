"""The queries that apply the operators to the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cminhash, decontam, editcount, htmltext, langid, linededup, linerules, packing, secretscan, surrogates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs")


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's secret: plumbline.surrogates.key."""
    return surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get("plumbline.surrogates.key", "change-me"))


def op4_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linerules.line_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cminhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and the count after two edits: twelve characters in its middle are masked, and a line is added at its end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    middle = F.floor(n / 2)
    masked = F.struct(middle.alias("start"), (middle + 12).alias("end"), F.lit("[masked]").alias("new"))
    added = F.struct((n + 8).alias("start"), (n + 8).alias("end"), F.lit("\nReviewed once.").alias("new"))
    return editcount.count_edits(docs.withColumn("edits", F.array(masked, added)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixture_langid, op2_nnls_packing, op3_surrogate_pii, op4_line_block_html, op5_benchmark_decontamination, op6_line_dedup, op7_line_first_quality,
        op8_token_efficiency_secrets, op9_circulant_minhash, op10_edit_aware_counts,
    )
}

_PHRASES = "|".join(x.replace("'", "''") for x in linerules.BOILERPLATE)

ORACLES: dict[str, str] = {
    "op7_line_first_quality": rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
run AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS n FROM run) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM doc)),
worded AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
most AS (SELECT doc_id, pos, max(n) AS top, coalesce(sum(n) FILTER (WHERE regexp_matches(v, '[.!?]$')), 0) AS inner_ends FROM (SELECT doc_id, pos, v, count(*) AS n FROM (SELECT doc_id, pos, unnest(w) AS v FROM worded) GROUP BY ALL) GROUP BY ALL),
measured AS (
  SELECT doc_id, x, len(w) AS n, length(array_to_string(w, '')) AS chars, top,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(x, '[^|]', '', 'g')) AS bars,
         length(regexp_replace(x, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(x, '[^a-z]', '', 'g')) AS lower,
         regexp_matches(w[len(w)], '[.!?…。！？।؟:;"'')\]}}”’»›」』）]$') AS ended, inner_ends,
         regexp_matches(low, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])({_PHRASES})([^\p{{L}}\p{{N}}\p{{M}}_]|$)') AS furniture
  FROM worded JOIN most USING (doc_id, pos)),
judged AS (SELECT *, 10 * symbols > chars OR (n >= 4 AND 10 * upper > 7 * greatest(upper + lower, 1)) OR NOT (ended OR (n >= 12 AND inner_ends * 60 >= n)) OR (bars >= 3 AND bars * 8 >= n)
                  OR (n >= 8 AND 2 * top > n) OR (n <= 16 AND furniture) AS fails FROM measured),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM doc LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= word_chars AS kept
FROM counted
""",
    "op5_benchmark_decontamination": r"""
WITH word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
piece AS (SELECT item_id, least(13, len(w)) AS size, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM piece),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM word, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT doc_id, i, s.size, item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM spot) s JOIN win ON s.t = win.t AND s.size = win.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM word LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH line AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS lost FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op9_circulant_minhash": r"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id > y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS seen FROM way UNION SELECT r.doc_id, w.b FROM reach r JOIN way w ON w.a = r.seen),
least AS (SELECT doc_id, min(seen) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
""",
}
