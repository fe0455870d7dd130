"""Queries on reconciliation: identities, gaps, edges, the manifest. Runs are order priorities, records orders, reports customers modulo 150."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..registry import query, table

_PERIOD = "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (2006 + (o_custkey % 150) // 12)::INT || '-' || lpad(((o_custkey % 150) % 12 + 1)::VARCHAR, 2, '0') END"
_OCC = f"""occ AS (SELECT o_orderpriority AS run_id, o_orderkey::VARCHAR AS record_id, o_orderkey AS source_line, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 150 END AS number,
  {_PERIOD} AS period, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_custkey % 4 = 0 THEN 'title ' || o_orderstatus ELSE 'title' END AS entry_title, 'page ' || (2004 + o_orderkey % 3)::VARCHAR AS page_title, NULL::VARCHAR AS description FROM orders),
links AS (SELECT o_orderpriority AS run_id, o_orderkey::VARCHAR AS record_id, o_custkey % 150 AS number, 'HTTPS://Example.org:443/' || (o_orderkey % 2)::VARCHAR || '?utm_source=x' AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'landing_page' ELSE 'direct_download' END AS role FROM orders),
acq AS (SELECT c_custkey AS number, CASE WHEN c_custkey % 10 = 0 THEN 'unresolved_opaque_filename' ELSE 'resolved' END AS association, sha256(c_name) AS sha256, length(c_name)::BIGINT AS bytes FROM customer WHERE c_custkey < 150 AND c_custkey % 2 = 0)"""


def _inputs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    run = [F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").cast("string").alias("record_id")]
    occ = o.select(
        *run, F.col("o_orderkey").alias("source_line"), F.expr("if(o_orderkey % 13 = 0, null, o_custkey % 150)").alias("number"),
        F.expr("if(o_orderkey % 9 = 0, null, concat(2006 + (o_custkey % 150) div 12, '-', lpad((o_custkey % 150) % 12 + 1, 2, '0')))").alias("period"),
        F.expr("case when o_orderkey % 5 = 0 then '' when o_custkey % 4 = 0 then concat('title ', o_orderstatus) else 'title' end").alias("entry_title"),
        F.expr("concat('page ', 2004 + o_orderkey % 3)").alias("page_title"), F.lit(None).cast("string").alias("description"),
    )
    links = o.select(*run, (F.col("o_custkey") % 150).alias("number"), F.expr("concat('HTTPS://Example.org:443/', o_orderkey % 2, '?utm_source=x')").alias("url"), F.expr("if(o_orderkey % 3 = 0, 'landing_page', 'direct_download')").alias("role"))
    acq = c.where("c_custkey < 150 AND c_custkey % 2 = 0").select(F.col("c_custkey").alias("number"), F.expr("if(c_custkey % 10 = 0, 'unresolved_opaque_filename', 'resolved')").alias("association"), F.sha2("c_name", 256).alias("sha256"), F.length("c_name").cast("long").alias("bytes"))
    return occ, links, acq


_KNOWN = "pairs AS (SELECT DISTINCT number, period FROM occ WHERE number IS NOT NULL AND period IS NOT NULL), known AS (SELECT number, min(period) AS period FROM pairs GROUP BY number)"


@query("WITH p AS (SELECT DISTINCT n_regionkey AS number, left(n_name, 1) AS period FROM nation), n AS (SELECT number, count(*) AS a, min(period) AS period FROM p GROUP BY 1), s AS (SELECT period, count(*) AS b FROM p GROUP BY 1) SELECT number, period, NOT (a > 1 OR b > 1) AS one_to_one FROM n JOIN s USING (period)")
def identity_bijection(spark, d):
    return R.identity_map(table(spark, d, "nation").selectExpr("n_regionkey AS number", "left(n_name, 1) AS period"), strict=False)


@query("WITH g AS (SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS m)) SELECT month FROM g WHERE month NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)")
def month_gaps(spark, d):
    return R.month_gaps(spark, table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period")), "1990-01", "2000-12")


_GAPS = f"""
WITH {_OCC}, {_KNOWN},
lead AS (SELECT y AS year, list_sort(list(DISTINCT run_id || ':' || record_id)) AS refs FROM occ, (VALUES ('2004'), ('2005')) v(y) WHERE number IS NULL AND contains(page_title || chr(10) || entry_title, y) GROUP BY y),
direct AS (SELECT number FROM links JOIN known USING (number) WHERE role = 'direct_download' GROUP BY number HAVING count(DISTINCT regexp_extract(url, '/([0-9])', 1)) > 1),
last AS (SELECT number, entry_title, arg_max(run_id || ':' || record_id, struct_pack(a := run_id, b := record_id, c := source_line)) AS ref FROM occ JOIN known USING (number) WHERE entry_title <> '' GROUP BY 1, 2),
titles AS (SELECT number, list_sort(list(DISTINCT ref)) AS refs FROM last GROUP BY number HAVING count(*) > 1),
g AS (SELECT 'gap-reference-month-' || strftime(m, '%Y-%m') AS gap_id, 'reference_month' AS dimension, strftime(m, '%Y-%m') AS expected_value, 'unobserved' AS evidence_status, 'historical_month_unresolved' AS classification, true AS manual, 'pending_human_review' AS disposition, NULL::BIGINT AS number, []::VARCHAR[] AS refs FROM (SELECT unnest(generate_series(DATE '2004-04-01', DATE '2005-12-01', INTERVAL 1 MONTH)) AS m)
UNION ALL SELECT 'gap-report-number-' || n, 'report_number', n::VARCHAR, 'unobserved', 'unobserved_report_number', true, 'pending_human_review', NULL, [] FROM (SELECT unnest(range(1, 23)) AS n)
UNION ALL SELECT 'gap-historical-unnumbered-lead-' || year, 'source_evidence', year, 'lead_only', 'historical_unnumbered_source_lead', true, 'retain_as_unnumbered_lead', NULL, refs FROM lead
UNION ALL SELECT 'gap-multiple-direct-url-bytes-' || number, 'version_ambiguity', number::VARCHAR, 'ambiguous', 'multiple_direct_url_bytes_unknown', true, 'pending_human_review', number, [] FROM direct
UNION ALL SELECT 'gap-byte-acquisition-' || number, 'byte_acquisition', number::VARCHAR, 'not_acquired', 'byte_acquisition_not_established', false, 'deferred_future_acquisition', number, [] FROM known WHERE number NOT IN (SELECT number FROM acq)
UNION ALL SELECT 'gap-opaque-direct-file-association-' || number, 'identity_ambiguity', number::VARCHAR, 'ambiguous', 'opaque_direct_file_association', true, 'pending_human_review', number, [] FROM acq WHERE association = 'unresolved_opaque_filename'
UNION ALL SELECT 'gap-source-title-review-' || number, 'source_evidence', number::VARCHAR, 'conflicting', 'source_metadata_requires_review', true, 'pending_human_review', number, refs FROM titles)"""


def _gaps(spark, d):
    occ, links, acq = _inputs(spark, d)
    return R.gap_register(spark, occ, links, acq, "2004-04", "2005-12", 22, ["2004", "2005"])


@query(f"{_GAPS} SELECT * FROM g")
def gap_register(spark, d):
    return _gaps(spark, d)


@query(f"{_GAPS} SELECT classification, count(*) AS n, bool_or(manual) AS manual FROM g GROUP BY 1")
def gap_counts(spark, d):
    return _gaps(spark, d).groupBy("classification").agg(F.count("*").alias("n"), F.bool_or("manual").alias("manual"))


@query(f"""{_GAPS}, t AS (SELECT number, list_sort(list(DISTINCT entry_title)) AS titles FROM occ WHERE entry_title <> '' AND number IS NOT NULL GROUP BY 1)
SELECT 'manifest-' || left(sha256(k.number::VARCHAR), 24) AS manifest_id, k.number, k.period, coalesce(titles, []) AS titles, CASE WHEN len(titles) = 1 THEN titles[1] END AS preferred_title,
CASE WHEN k.number IN (SELECT number FROM acq) THEN 'byte_verified_identical' ELSE 'not_acquired' END AS acquisition_state,
CASE WHEN k.number IN (SELECT number FROM g WHERE manual AND number IS NOT NULL) THEN 'requires_human_review' WHEN k.number IN (SELECT number FROM acq) THEN 'verified' ELSE 'candidate' END AS review_status
FROM known k LEFT JOIN t USING (number)""")
def manifest(spark, d):
    occ, links, acq = _inputs(spark, d)
    return R.manifest(occ, acq, _gaps(spark, d))


@query(f"""WITH {_OCC}, {_KNOWN} SELECT 'edge-' || left(sha256(concat_ws(chr(31), 'urls', number::VARCHAR)), 24) AS edge_id, number, 'multiple_official_urls' AS relation, ['https://example.org/0', 'https://example.org/1'] AS members FROM links JOIN known USING (number) WHERE role = 'direct_download' GROUP BY number HAVING count(DISTINCT right(regexp_extract(url, '/[01]'), 1)) > 1
UNION ALL SELECT 'edge-' || left(sha256(concat_ws(chr(31), 'bytes', number::VARCHAR, sha256)), 24), number, 'exact_identical_bytes', [sha256] FROM acq
UNION ALL SELECT 'edge-' || left(sha256(concat_ws(chr(31), 'candidate', run_id, record_id, 'r1')), 24), number, 'candidate_same_report_without_byte_evidence', list_sort([record_id, run_id]) FROM links JOIN known USING (number) WHERE record_id::BIGINT % 6 = 0""")
def version_edges(spark, d):
    occ, links, acq = _inputs(spark, d)
    relations = links.where("record_id % 6 = 0").select("run_id", "record_id", "number", F.lit("r1").alias("relation_id"), F.col("record_id").alias("observation_id"), F.col("run_id").alias("related_id"), F.lit("").alias("rationale"))
    return R.version_edges(occ, links, relations, acq)


@query('SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS distinct_keys, min(o_orderdate) AS "first", max(o_orderdate) AS "last" FROM orders')
def coverage_report(spark, d):
    return R.coverage(table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS preferred, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1")
def title_preference(spark, d):
    langs = F.array_sort(F.collect_set("lang"))
    return table(spark, d, "documents").groupBy("source").agg(langs.alias("langs")).select("source", F.when(F.size("langs") == 1, F.get("langs", F.lit(0))).alias("preferred"), "langs")


@query("SELECT sha256(text) AS sha, min(strlen(text))::BIGINT AS bytes, count(*) AS observations, count(DISTINCT (source, lang)) AS urls FROM documents GROUP BY 1")
def content_versions(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))
    return R.content_versions(docs, ["source", "lang"], "sha", "size")


@query("WITH u AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END || CASE WHEN regexp_matches(url, '[?]page=[0-9]+&ref=x') THEN regexp_extract(url, '[?]page=[0-9]+&ref=x') ELSE '' END AS normal, url FROM pages) SELECT page_id, normal, regexp_extract(normal, '^https?://([^/:]+)', 1) AS host, CASE WHEN regexp_matches(normal, '[.](pdf|docx?|xlsx?|zip)$') THEN 'direct_download' WHEN regexp_matches(split_part(normal, '?', 1), '([.]html?|/)$') THEN 'landing_page' ELSE 'other' END AS role FROM u")
def url_normalize(spark, d):
    from ..functions.scalars import host_of, link_role, normalize_url

    return table(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("normal"), host_of(F.col("url")).alias("host"), link_role(F.col("url")).alias("role"))
