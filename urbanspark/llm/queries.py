"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, divergence, exact_dedup, flac, license_scan, mixing, packing, quality, secret_scan, simhash, toxicity, url_filters
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages")).drop("component")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("uid")


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_report(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_url_filters, op3_toxicity, op4_packing, op5_license_scan, op6_source_mixing, op7_simhash_neardup, op8_secret_scan, op9_exact_dedup,
        op10_flac_media, op11_decontamination, op12_centroids, op13_source_divergence,
    )
}

#: Longest rule first; an alias shares the address without scheme, www., query, fragment and last slash.
_OP2 = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(host_r, path_r, rule, v) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
h AS (
  SELECT page_id, url, host, path, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS node,
    (SELECT arg_max(struct_pack(v := v, rule := rule), length(rule)) FROM r
     WHERE (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r)) AS hit
  FROM p),
c AS (SELECT node, min(hit.v) AS said FROM h WHERE host <> '' AND hit IS NOT NULL GROUP BY node)
SELECT page_id, h.host, path, hit.rule AS rule, coalesce(hit.v, said, 'allow') AS verdict
FROM h LEFT JOIN c ON h.node = c.node AND h.host <> ''
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r, count(*) OVER (PARTITION BY h) AS group_size,
  first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM g
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT o.r, o.i, o.n, p.item_id FROM o JOIN p USING (n, phrase)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _op12() -> str:
    """Five rounds and a last assignment, a few table expressions each."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    near = f"SELECT vec_id, v, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM (SELECT e.r, vec_id, v, c, {distance} AS d FROM e, {{0}}) GROUP BY r, vec_id, v"
    parts = [
        """e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e ORDER BY h LIMIT 40))",
    ]
    for k in range(5):
        parts += [
            f"n{k} AS MATERIALIZED ({near.format(f'c{k}')})",
            f"s{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM n{k}) GROUP BY c, i)",
            f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY c)",
            f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))",
        ]
    parts.append(f"z AS ({near.format('c5')})")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c5 ON z.c = c5.c"""


_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS terms, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
m AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT m.lang, m.source, k.term, coalesce(n, 0) AS n, CAST(1 + (1000000000 * (coalesce(n, 0) + 1)) // (size + terms) AS BIGINT) AS p, CAST(1 + (1000000000 * (total + 1)) // (all_n + terms) AS BIGINT) AS q
  FROM m JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM terms) WHERE "rank" <= 200
"""

SQL: dict[str, str] = {"op2_url_filters": _OP2, "op9_exact_dedup": _OP9, "op11_decontamination": _OP11, "op12_centroids": _op12(), "op13_source_divergence": _OP13}
