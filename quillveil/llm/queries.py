"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, corpus_queries, decontaminate, embed, jaccard, pii, quality, suffix, token_counts, warc
from .common import shared_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.capture_histories(pages, shared_dir(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM r
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, P.path(RANKS), P.PATTERN, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("lang", "text")
    ids = bpe.encoded(docs, P.path(RANKS), P.PATTERN)
    lengths = token_counts.length_histogram(ids.select("lang", bpe.n_tokens().alias("n_tokens")), "n_tokens", by=("lang",))
    return token_counts.context_limits(lengths, by=("lang",))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"), shared_dir(spark))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
     n AS (SELECT *, octet_length(b)::BIGINT AS n FROM d),
     p AS (SELECT r, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200),
     h AS (SELECT p.r, p.i, hash(array_slice(b, p.i, p.i + 199)) AS h FROM p JOIN n USING (r)),
     again AS (SELECT r, i FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
     runs AS (SELECT r, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
              FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)),
     spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS e FROM runs GROUP BY r, run),
     gone AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
     cuts AS (SELECT r, a, e FROM spans UNION ALL SELECT r, n + 1, n + 1 FROM n),
     gaps AS (SELECT r, a, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a, e), 1) AS e FROM cuts),
     kept AS (SELECT r, unhex(string_agg(CASE WHEN a > e THEN hex(array_slice(b, e, a - 1)) ELSE '' END, '' ORDER BY a)) AS kept
              FROM gaps JOIN n USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(kept) AS kept_sha256
FROM n JOIN kept USING (r) LEFT JOIN gone USING (r)
"""


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
     t AS (SELECT item_id::VARCHAR AS item, least(len(w), 10) AS size, w
           FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
           WHERE len(w) > 0),
     windows AS (SELECT DISTINCT size, item, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM t)),
     places AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
            FROM (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
     met AS (SELECT r, i, size, item FROM places JOIN windows USING (size, g)),
     hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM met)) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


#: A conversation whose texts hold control strings and escapes.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    scratch = shared_dir(spark)
    messages = chat.linear(turns.unionByName(hard))
    out = chat.formatted(messages, chat.paths(messages, scratch))
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("under_loss", chat.loss_text(F.col("formatted"), F.col("loss")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
     e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h')) AS n_text,
                  length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c')) AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + n_role + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), shared_dir(spark))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
     good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
     least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
     n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op8_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), shared_dir(spark))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == "email")), F.size(F.filter("base", lambda s: s["kind"] == "ip")), F.size(F.filter("base", lambda s: s["kind"] == "card")), F.size(F.filter("base", lambda s: s["kind"] == "phone"))]
    return found.select(
        "doc_id", *(c.cast("long").alias(f"n_{kind}") for c, kind in zip(counts, pii.KINDS, strict=True)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), shared_dir(spark))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     one AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     links AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
     least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN least ON least.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


#: Labels that mark a document as wanted.
WANTED = "quality = 1 AND toxic = 0"


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.resampled(docs, labels, WANTED, shared_dir(spark), keep=["doc_id"])


QUERIES = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_winnowing": op5_winnowing,
    "op6_reply_trees": op6_reply_trees,
    "op7_p_stable": op7_p_stable,
    "op8_sanitisation": op8_sanitisation,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_importance_resampling": op10_importance_resampling,
    "op3_token_counts": op3_token_counts,
} | corpus_queries.QUERIES

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_winnowing": OP5_SQL,
    "op6_reply_trees": OP6_SQL,
    "op7_p_stable": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
} | corpus_queries.ORACLE_SQL
