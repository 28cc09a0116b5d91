"""The operators over their whole tables, by query name, and SQL for those that have it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontamination, embeddings, interactions, lines, manifest, mixing, preferences, products, sharding, simhash, substrings, toxicity, twins,
    warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").where(~toxicity.held_out())
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


@query
def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    sharded = sharding.external_shuffle(table(spark, d, "documents"), shards=24)
    return sharded.select(
        "doc_id", sharding.record_bytes().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived_pages(table(spark, d, "pages"))


@query
def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_substrings(spark: SparkSession, d: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.embedding_duplicates(table(spark, d, "embeddings"))


@query
def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, d, "documents"))
    rows = plan.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"), "source")


@query
def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    marked = decontamination.mark_contamination(
        table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    hit = decontamination.n_hit()
    return marked.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op9_preferences(spark: SparkSession, d: str) -> DataFrame:
    return preferences.format_preferences(preferences.swapped_replies(
        preferences.conversations(table(spark, d, "conversations"))))


@query
def op10_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, d, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = fields | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", manifest.record_digest(list(fields.values())).alias("leaf"),
                         F.when(tampered, manifest.record_digest(list(changed.values()))).alias("replacement"))
    return manifest.manifest(leaves).select(
        "doc_id", "leaf", "subroot", "root", manifest.siblings_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_interactions(spark: SparkSession, d: str) -> DataFrame:
    counts = interactions.mask_counts(spark, f"{d}/documents.parquet", table(spark, d, "labels"))
    return interactions.interactions(counts)


@query
def op13_products(spark: SparkSession, d: str) -> DataFrame:
    return products.top_products(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


_OP8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, starts.n, item FROM starts JOIN windows USING (n, phrase)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP3 = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS lead FROM sized WHERE n >= 100 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM sized LEFT JOIN firsts USING (digest)
"""

_OP5 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT phrase, min(doc_id) AS lead FROM starts GROUP BY phrase HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM starts JOIN firsts USING (phrase) WHERE doc_id > lead
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words) ANTI JOIN gone USING (doc_id, k)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP9 = """
WITH turns AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, 'unknown'), text := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), upto AS (
  SELECT conv_id, t[1:last_reply] AS chosen, t[last_reply] AS reply
  FROM (SELECT *, len(t) - list_position(list_reverse(list_transform(t, lambda x: x.role = 'assistant')), true) + 1 AS last_reply
        FROM turns) WHERE last_reply IS NOT NULL
), pairs AS (
  SELECT a.conv_id, b.conv_id AS other_id, a.chosen,
    list_concat(a.chosen[1:len(a.chosen) - 1], [struct_pack(turn := a.reply.turn, role := a.reply.role, text := b.reply.text)]) AS rejected
  FROM upto a JOIN upto b ON b.conv_id = xor(a.conv_id, 1)
), cut AS (
  SELECT *, CASE WHEN chosen[len(chosen)].text = rejected[len(rejected)].text THEN len(chosen) ELSE len(chosen) - 1 END AS n FROM pairs
)
SELECT conv_id, other_id, CAST(n AS INTEGER) AS n_prompt_turns,
  {prompt} AS prompt, {chosen} AS chosen_text, {chosen_mask} AS chosen_mask, {rejected} AS rejected_text, {rejected_mask} AS rejected_mask
FROM cut
"""


def _op9() -> str:
    head = "'<|im_start|>' || x.role || chr(10)"
    body = "x.text || '<|im_end|>'"
    turn = f"lambda x: {head} || {body} || chr(10)"
    runs = (f"lambda x: CASE WHEN x.role = 'assistant' THEN '0:' || length({head}) || ',1:' || length({body}) || ',0:1' "
            f"ELSE '0:' || (length({head}) + length({body}) + 1) END")
    joined = lambda rows, f, by: f"coalesce(array_to_string(list_transform({rows}, {f}), '{by}'), '')"
    return _OP9.format(
        prompt=joined("chosen[1:n]", turn, ""), chosen=joined("chosen[n + 1:]", turn, ""), chosen_mask=joined("chosen[n + 1:]", runs, ","),
        rejected=joined("rejected[n + 1:]", turn, ""), rejected_mask=joined("rejected[n + 1:]", runs, ","))


_OP10 = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^ \\t]') GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT lines.*, spread.line IS NOT NULL AS gone FROM lines LEFT JOIN spread USING (line)
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""

_OP13 = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
) WHERE rank <= 5
"""

SQL: dict[str, str] = {
    "op3_warc": _OP3, "op5_substrings": _OP5, "op8_decontamination": _OP8, "op9_preferences": _op9(), "op10_lines": _OP10,
    "op11_manifest": twins.manifest(), "op12_interactions": twins.interactions(),
    "op13_products": _OP13,
}
