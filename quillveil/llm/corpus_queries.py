"""Registered queries over the whole corpus: phrases, mixtures, ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mix, phrases, search
from .common import shared_dir, table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), shared_dir(spark))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
     f AS MATERIALIZED (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
     cuts AS (SELECT lang, size, phrase, w, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
     scored AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
                FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
     best AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     subs AS (SELECT lang, f AS longer, array_to_string(w[i:i + s - 1], ' ') AS phrase
              FROM (SELECT lang, f, w, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT lang, f, w, size, unnest(range(2, size)) AS s FROM f WHERE size > 2))),
     most AS (SELECT lang, phrase, max(longer) AS longer FROM subs GROUP BY lang, phrase),
     kept AS (SELECT b.* FROM best b LEFT JOIN most m USING (lang, phrase) WHERE m.longer IS NULL OR 100 * m.longer < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mixture(table(spark, sf_dir, "documents"), shared_dir(spark))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
     f AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
                  coalesce(sum(3 * source_size) OVER o, 0) AS most_before, coalesce(sum(w) OVER o, 0) AS w_before
           FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     g AS (SELECT *, most * (w_all - w_before) <= w * (total - most_before) AS stops FROM f),
     t AS (SELECT source, source_size, CASE WHEN stops THEN most::DOUBLE ELSE
                  (total - coalesce(sum(most) FILTER (stops) OVER (), 0))::DOUBLE * w / (w_all - coalesce(sum(w) FILTER (stops) OVER (), 0))::DOUBLE END AS target FROM g),
     b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
     r AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM r
"""

def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
     tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
     wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, n_docs),
     sums AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * n_docs) // n_all))))::BIGINT AS score
              FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN d USING (r), s GROUP BY item_id, r),
     best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
              FROM sums JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""

QUERIES = {
    "op11_collocations": op11_collocations,
    "op12_source_mix": op12_source_mix,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": OP11_SQL,
    "op12_source_mix": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
