"""The registered queries: every operator over its whole table with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import quality as quality_model
from tidewatch.llm import toxicity as toxicity_model
from tidewatch.llm.collisions import coordinate_duplicates
from tidewatch.llm.decontaminate import contamination
from tidewatch.llm.exact import exact_duplicates
from tidewatch.llm.interaction import filter_audit
from tidewatch.llm.jaccard import near_duplicates
from tidewatch.llm.labelled import held_out
from tidewatch.llm.layout import visible_text
from tidewatch.llm.negatives import hard_negatives
from tidewatch.llm.packing import pack
from tidewatch.llm.randomness import digest, find_secrets
from tidewatch.llm.registry import ORACLES, QUERIES, query, table
from tidewatch.llm.tokens import token_counts
from tidewatch.llm.warc import capture_index

__all__ = ["QUERIES", "ORACLES"]


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM d"""


@query("op1_warc_index_merge", OP1_SQL)
def op1(spark, sf_dir):
    index = capture_index(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_html_layout_text")
def op2(spark, sf_dir):
    return visible_text(table(spark, sf_dir, "pages", "page_id", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWERED}, ''), '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
        FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (n, words)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def scored(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    model = quality_model.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored(quality_model.quality(documents(spark, sf_dir), model))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def similar_sql(width: int, more: str = "") -> str:
    """Components of documents whose sets of ``width``-word shingles are similar by 80 % or more."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id{more}
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)"""


@query("op6_ngram_jaccard_join", similar_sql(5))
def op6(spark, sf_dir):
    classes, _ = near_duplicates(documents(spark, sf_dir))
    return classes.select("doc_id", "n_shingles", "component_id")


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack(documents(spark, sf_dir), capacity=4096, end_id=1)


@query("op8_secret_scans")
def op8(spark, sf_dir):
    found = find_secrets(documents(spark, sf_dir)).withColumn("base", F.expr("filter(spans, x -> x.kind <> 'random')"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "random")]
    return found.select("doc_id", *counts, F.sha2(F.expr(digest("base")), 256).alias("base_sha256"), F.expr(digest("spans")).alias("spans"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    model = toxicity_model.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored(toxicity_model.toxicity(documents(spark, sf_dir), model))


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 2048)


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS INTEGER)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS prior FROM orders, range(1, 6) AS r(step)),
res AS (SELECT part, filter_order, step, bit, sum(n) FILTER ((mask & (bit | prior)) = 0) AS kept, sum(n) FILTER ((mask & bit) <> 0 AND (mask & prior) = 0) AS removed,
        sum(n) FILTER ((mask & bit) <> 0 AND (mask & prior) <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER ((mask & bit) <> 0 AND (mask & prior) = 0) AS good_lost, sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & prior) = 0) AS toxic_lost
        FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM res"""


@query("op11_filter_interaction_audit", OP11_SQL)
def op11(spark, sf_dir):
    return filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op12_minhash_near_dedup", similar_sql(4, ", d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept"))
def op12(spark, sf_dir):
    classes, _ = coordinate_duplicates(documents(spark, sf_dir))
    return classes.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS other, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE own = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER k AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND other <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW k AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER k <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)
