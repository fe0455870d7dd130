"""Queries on web pages, page geometry, addressed tables and the inspection store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import addressed as A
from ..operators import discovery as D
from ..operators import geometry as G
from ..registry import query, table
from .inspection import ROLES_PRIORITY, ROLES_REGIONAL, Store


_NAMES = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'setiembre', 'octubre', 'noviembre', 'diciembre']"


@query(f"""WITH p AS (SELECT *, page_id % 400 + 1 AS n, page_id % 12 + 1 AS m FROM pages)
SELECT url AS page_url, regexp_extract(url, '^https?://[^/?#]+') || '/page/' || page_id + 1 || '/' AS next_url, 0 AS scope, n::INT AS number, '2010-' || lpad(m::VARCHAR, 2, '0') AS period,
  'Reporte de conflictos sociales n.° ' || n || ' – ' || {_NAMES}[m] || ' 2010' AS title, '13/08/' || 2010 + page_id % 9 AS date, 2 AS links FROM p""")
def html_records(spark, d):
    """Records of catalogue pages: each page of the table behind an entry about a report, with a link to the next page."""
    pages = table(spark, d, "pages")
    n, month = (F.col("page_id") % 400 + 1).cast("string"), F.element_at(F.array(*[F.lit(x) for x in _NAMES.strip("[]").replace("'", "").split(", ")]), (F.col("page_id") % 12 + 1).cast("int"))
    entry = F.concat(
        F.lit('<a rel="next" href="/page/'), F.col("page_id") + 1, F.lit('/">»</a><article><a href="/doc/'), n, F.lit('/">Reporte de conflictos sociales n.° '), n, F.lit(" – "), month, F.lit(" 2010</a><a href='/up/r"), n,
        F.lit(".pdf'>PDF</a><p>Publicado: 13/08/"), (2010 + F.col("page_id") % 9).cast("string"), F.lit("</p></article>"),
    )
    found = D.parse_pages(pages.select(F.col("url").alias("page_url"), F.lit("catalogue").alias("page_role"), F.concat(entry, "html").alias("html")))
    return found.select("page_url", "next_url", "scope", "number", "period", "title", "date", F.size("links").alias("links"))


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), n AS (SELECT page_id, lead(page_id) OVER (ORDER BY page_id) AS nxt, row_number() OVER (ORDER BY page_id) AS place FROM h WHERE host = (SELECT host FROM h WHERE page_id = 0)) SELECT page_id::VARCHAR AS page_url, place, CASE WHEN nxt IS NULL THEN 'no_next_link' WHEN place >= 24 THEN 'page_cap' END AS stop FROM n WHERE place <= 24")
def page_walk(spark, d):
    """From the first page on along the next page of the same host, 24 pages at most: the cap is the feature."""
    from pyspark.sql import Window

    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_url"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), "page_id")
    links = pages.withColumn("next_url", F.lead("page_url").over(Window.partitionBy("host").orderBy("page_id")))
    return D.walk(links, "0", 24)


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 300 + 1 AS n, year(o_orderdate) AS y, month(o_orderdate) AS m, {_NAMES}[month(o_orderdate)] AS name FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 THEN n::INT END AS number, CASE k WHEN 0 THEN y || '-06' WHEN 1 THEN y || '-' || lpad(m::VARCHAR, 2, '0') WHEN 2 THEN y || '-' || lpad(m::VARCHAR, 2, '0') WHEN 3 THEN NULL ELSE NULL END AS period,
  CASE k WHEN 3 THEN 'lunes, 7 ' || name || ' ' || y WHEN 4 THEN name || ' 7, ' || y END AS date,
  CASE k WHEN 0 THEN 'reporte no ' || n || ' – jun-' || y WHEN 1 THEN 'conflictos n. ' || n || ' ' || name || ' -' || y WHEN 2 THEN 'reporte ' || n || ' ' || y || ' ' || name WHEN 3 THEN 'publicado lunes, 7 ' || name || ' ' || y ELSE 'region ' || name || ' 7, ' || y END AS folded FROM o""")
def report_texts(spark, d):
    """Numbers, periods and dates of texts in five forms, one for each order."""
    o = table(spark, d, "orders")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES.strip("[]").replace("'", "").split(", ")]), F.month("o_orderdate"))
    n, y, k = (F.col("o_orderkey") % 300 + 1).cast("string"), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    text = F.when(k == 0, join("Reporte Nº ", n, " – Jun-", y)).when(k == 1, join("CONFLICTOS n. ", n, "  ", F.initcap(name), " -", y)).when(k == 2, join("reporte ", n, " ", y, " ", name))
    text = text.when(k == 3, join("Publicado lunes, 7 ", name, " ", y)).otherwise(join("Región ", name, " 7, ", y))
    t = F.col("t")
    return o.select("o_orderkey", text.alias("t")).select("o_orderkey", S.report_number(t).alias("number"), S.reference_period(t).alias("period"), S.date_text(t).alias("date"), S.fold(t).alias("folded"))


def _table_words(spark, d, labels, cells):
    """Orders as pages of one table: labels (text, x0, x1) on top, then the cells (text, x0, x1) of each line; a null text leaves its cell empty."""
    o = table(spark, d, "orders").select("o_orderkey")
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")])
    as_words = lambda ws: F.array(*[F.struct((F.lit(t) if isinstance(t, str) else t).cast("string").alias("text"), (F.lit(0.0) + x0).alias("x0"), (F.lit(0.0) + x1).alias("x1")) for t, x0, x1 in ws])
    top = o.select("o_orderkey", F.lit(0).alias("n"), F.posexplode(as_words(labels)).alias("k", "w"))
    rows = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("l_linenumber").cast("int").alias("n"), F.posexplode(as_words(cells)).alias("k", "w"))
    y = 10.0 + 20.0 * F.col("n")
    return top.unionByName(rows).where("w.text IS NOT NULL").select(
        F.col("o_orderkey").cast("string").alias("page_id"), (len(labels) * F.col("n") + F.col("k")).alias("word_index"), "w.text", "w.x0", y.alias("y0"), "w.x1", (y + 10.0).alias("y1"), F.lit(250.0).alias("width"), F.lit(400.0).alias("height"),
    )


def _words(spark, d):
    """Pages of the columns of each line under the labels of a regional table."""
    label = F.when(F.col("l_discount") >= 0.1, "7").otherwise(F.col("l_returnflag"))
    cells = [(label, 0.0, 30.0), (F.col("l_quantity").cast("int"), 100.0, 130.0), (F.concat(F.col("l_discount").cast("string"), F.lit("%")), 190.0, 220.0)]
    return _table_words(spark, d, [("Región", 0.0, 30.0), ("Total", 100.0, 130.0), ("%", 190.0, 220.0)], cells)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 0 FROM orders),
i AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS island FROM l),
r AS (SELECT k, min(n) AS first, max(n) AS last, count(*) AS lines FROM i GROUP BY k, island)
SELECT k::VARCHAR AS page_id, row_number() OVER (PARTITION BY k ORDER BY first) - 1 AS region,
  CASE WHEN k % 3 = 2 THEN 'ambiguous_region' WHEN lines = 1 THEN 'candidate_continuation_or_context' WHEN k % 3 = 1 THEN 'unclassified_or_unprocessed' ELSE 'candidate_tabular_region' END AS classification,
  CASE WHEN lines = 1 OR k % 3 = 1 THEN 'whole_spatial_component' ELSE 'multi_run_core' END AS part_role, lines, 3 * lines AS words, 0.0::DOUBLE AS x0, 10.0::DOUBLE + 20 * first AS y0, CASE WHEN k % 3 = 1 THEN 250.0 ELSE 220.0 END::DOUBLE AS x1, 20.0::DOUBLE + 20 * last AS y1 FROM r""")
def region_admission(spark, d):
    """Pages of three kinds: words in columns, words in running lines, and words that overlap."""
    kind = F.col("page_id").cast("long") % 3
    of = lambda plain, running, touching: F.when(kind == 1, running).when(kind == 2, touching).otherwise(plain)
    at = F.col("word_index") % 3
    x0 = F.when(at == 1, of(100.0, 70.0, 20.0)).when(at == 2, of(190.0, 160.0, 190.0)).otherwise(0.0)
    x1 = F.when(at == 1, of(130.0, 150.0, 130.0)).when(at == 2, of(220.0, 250.0, 220.0)).otherwise(of(30.0, 60.0, 30.0))
    return G.region_admission(_words(spark, d).withColumns({"x0": x0, "x1": x1}))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q, min(l_discount) AS disc, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
o AS (SELECT k, n, q, disc, f, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS "row", max((disc >= 0.1)::INT) OVER (PARTITION BY k ORDER BY n) AS stopped FROM l WHERE k IN (SELECT o_orderkey FROM orders)),
kept AS (SELECT * FROM o WHERE stopped = 0)
SELECT k::VARCHAR AS page_id, 'populated_partial_source_evidence' AS status, "row", 'regional_category' AS row_kind, f AS category, q::INT::VARCHAR AS count, disc::VARCHAR || '%' AS percentage FROM kept
UNION ALL SELECT o_orderkey::VARCHAR, 'no_qualified_rows', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM kept)""")
def regional_rows(spark, d):
    return G.regional_table(_words(spark, d))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q, min(l_linestatus) AS s, min(l_returnflag) AS f FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
t AS (SELECT k, CASE WHEN max(q) > 45 THEN 'partial' ELSE 'processed' END AS status FROM l GROUP BY k),
c AS (SELECT k, n, unnest([1, 2, 3]) AS "column", unnest([f, s, CASE WHEN q <= 45 THEN q::INT::VARCHAR END]) AS value FROM l)
SELECT k::VARCHAR AS page_id, status, 4 * n AS ordinal_word, n || '.' AS ordinal, "column", CASE WHEN value IS NULL THEN 'unavailable_no_qualified_words' ELSE 'processed' END AS cell_status, value FROM c JOIN t USING (k)
UNION ALL SELECT o_orderkey::VARCHAR, 'no_qualified_ordinals', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM l)""")
def priority_rows(spark, d):
    """Lines as numbered rows; large quantities leave the last cell empty."""
    labels = [("N.°", 0.0, 12.0), ("Lugar", 40.0, 65.0), ("Caso", 110.0, 135.0), ("Situación", 190.0, 235.0)]
    cells = [(F.concat("l_linenumber", F.lit(".")), 2.0, 10.0), (F.col("l_returnflag"), 40.0, 75.0), (F.col("l_linestatus"), 110.0, 140.0), (F.when(F.col("l_quantity") <= 45, F.col("l_quantity").cast("int")), 190.0, 230.0)]
    return G.priority_table(_table_words(spark, d, labels, cells))


@query("""WITH p AS (SELECT o_orderkey AS input_id, unnest(range(1, 5)) AS "row" FROM orders), g AS (SELECT input_id, "row", unnest(['flag', 'quantity']) AS field FROM p), l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1, 2)
SELECT input_id, g."row", field, CASE WHEN input_id % 8 = 0 THEN 'unprocessed' WHEN l.l_orderkey IS NULL THEN 'missing' WHEN field = 'flag' THEN 'text' ELSE 'number' END AS status FROM g LEFT JOIN l ON l.l_orderkey = input_id AND l_linenumber = g."row\"""")
def addressed_cells(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    plan = o.select(F.col("o_orderkey").alias("input_id"), F.lit(0).alias("table_index"), F.lit(1).alias("first_row"), F.lit(4).alias("last_row"), F.expr("array(named_struct('column', 0, 'field', 'flag'), named_struct('column', 1, 'field', 'quantity'))").alias("columns"))
    lines = l.where("l_orderkey % 9 <> 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").alias("q"))
    cells = lines.select(F.col("l_orderkey").alias("input_id"), F.lit(0).alias("table_index"), F.col("l_linenumber").alias("row"), F.expr("stack(2, 0, concat('\"', f, '\"'), 1, cast(q AS string)) AS (column, value)"))
    return A.extract(plan, cells, o.where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("input_id"))).select("input_id", "row", "field", "status")


def store(spark, d) -> Store:
    """An inspection store made of orders (units), line numbers (rows) and their columns (cells)."""
    o = table(spark, d, "orders")
    l = table(spark, d, "lineitem")
    l = l.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")])
    unit, text = F.col("o_orderkey").cast("string"), lambda *c: F.concat_ws(":", *c)
    u = o.select(unit.alias("unit_key"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").cast("int").alias("physical_page"), F.lit("{}").alias("provenance_json"), F.lit("{}").alias("exposure_json"), F.lit("{}").alias("permissions_json"))
    manifest = u.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.col("unit_key"))), lambda k: F.struct(k.alias("sha256"))).alias("views"))).alias("value_json")).select(F.lit("source_manifest").alias("key"), "value_json")
    meta = manifest.unionByName(spark.createDataFrame([("scope", '"invented"'), ("other", "1")], "key string, value_json string"))
    key = F.col("l_orderkey").cast("string")
    rows = l.select(text(key, "l_linenumber").alias("row_key"), key.alias("unit_key"), F.col("l_linenumber").alias("ordinal"), F.lit("null").alias("local_label_json"), F.when(F.col("l_linenumber") == 1, "header").otherwise("body").alias("row_class"), F.lit('"primary"').alias("documentary_role_json"))
    roles = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, ROLES_PRIORITY))).otherwise(F.array(*map(F.lit, ROLES_REGIONAL)))
    columns = o.select(unit.alias("unit_key"), F.posexplode(roles).alias("ordinal", "column_role")).select(text("unit_key", F.lit("c"), "ordinal").alias("column_key"), "unit_key", "ordinal", F.col("ordinal").alias("source_index"), "column_role", F.lit('""').alias("label_json"))
    cells = l.select("l_orderkey", "l_linenumber", F.posexplode(F.array(F.to_json(F.struct("l_returnflag")), F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"))).alias("c", "value_json"))
    k = F.col("l_orderkey").cast("string")
    cell_key = text(k, "l_linenumber", "c")
    all_cells = cells.select(cell_key.alias("cell_key"), k.alias("unit_key"), text(k, F.lit("c"), "c").alias("column_key"), F.when(F.col("l_linenumber") == 1, "header").otherwise("body").alias("cell_class"), S.json_kind(F.col("value_json")).alias("value_type"), "value_json")
    t = {
        "snapshot_metadata": meta, "unit_order": u.select(F.col("unit_key").alias("unit_ordinal"), "unit_key"), "units": u, "documentary_rows": rows, "documentary_columns": columns, "cells": all_cells,
        "row_cells": cells.select(text(k, "l_linenumber").alias("row_key"), F.col("c").alias("ordinal"), cell_key.alias("cell_key")),
        "contexts": o.select(text(F.lit("x"), unit).alias("context_key"), unit.alias("unit_key"), F.lit("caption").alias("kind")),
        "segments": l.select(text(F.lit("x"), key).alias("owner_key"), F.col("l_linenumber").alias("ordinal"), F.col("l_linestatus").alias("exact_text")),
        "dependencies": l.select(text(key, "l_linenumber", F.lit("d")).alias("dependency_key"), key.alias("unit_key"), F.col("l_linenumber").alias("ordinal"), F.lit("name").alias("name"), F.when(F.col("l_linestatus") == "O", "unknown").otherwise("confirmed_none").alias("state")),
        "source_records": cells.select(cell_key.alias("address"), F.sha2(cell_key, 256).alias("document_sha256"), F.lit("/0").alias("pointer"), F.lit(None).cast("string").alias("historical_record_sha256")),
        "words": l.select(text(key, "l_linenumber", F.lit("w")).alias("word_key"), F.col("l_returnflag").alias("text"), F.lit("[0,1]").alias("span_json"), F.lit("[]").alias("bbox_json"), F.lit("f").alias("frame")),
        "owner_words": cells.select(cell_key.alias("owner_key"), F.col("l_linenumber").alias("ordinal"), text(k, "l_linenumber", F.lit("w")).alias("word_key")),
        "word_links": l.where("l_linenumber % 2 = 0").select(text(key, "l_linenumber", F.lit("w")).alias("word_key"), F.lit(0).alias("ordinal"), F.lit("evidence").alias("kind"), text(key, F.lit("r")).alias("record_key")),
        "assertions": o.select(text(unit, F.lit("a")).alias("assertion_key"), unit.alias("unit_key"), unit.alias("source_record"), F.lit("{}").alias("attribution_json"), F.lit("absent").alias("stage_presence"), F.lit(None).cast("string").alias("stage_json")),
        "assertion_links": o.where("o_orderkey % 3 = 0").select(text(F.lit("x"), unit).alias("owner_key"), F.lit(0).alias("ordinal"), text(unit, F.lit("a")).alias("assertion_key")),
        "qualifiers": o.select(text(unit, F.lit("q")).alias("qualifier_key"), unit.alias("unit_key"), F.lit("note").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, "table_proposal").otherwise("column").alias("target_kind"), text(unit, F.lit("c"), F.lit("1")).alias("target_column")),
    }
    return Store(t)


_STORE = """u AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS unit_key, o_orderpriority AS label, o_orderkey::INT AS physical_page, '{}' AS provenance_json, '{}' AS exposure_json, '{}' AS permissions_json FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q, min(l_discount) AS d, min(l_returnflag) AS f, min(l_linestatus) AS s, l_orderkey || ':' || l_linenumber AS row_key FROM lineitem GROUP BY 1, 2),
t AS (SELECT k, string_agg(s, chr(10) ORDER BY n) AS literal, count(*) FILTER (s = 'O') AS unknown FROM l GROUP BY k),
c AS (SELECT k, n, i, row_key || ':' || i AS cell_key FROM l, (VALUES (0), (1), (2)) v(i))"""
_PIVOT = """SELECT n AS ordinal, row_key, '"primary"' AS documentary_role_json, '{"l_returnflag":"' || f || '"}' AS a, row_key || ':0' AS a0, q::VARCHAR AS b, row_key || ':1' AS b0, d::VARCHAR AS c, row_key || ':2' AS c0, 'x:' || k AS context_key, literal, unknown, k FROM l JOIN t USING (k) WHERE n > 1"""
_SQL = {
    "units": f"WITH {_STORE} SELECT unit_key, label, physical_page, provenance_json, exposure_json, permissions_json, count(n) FILTER (n > 1) AS body_rows, 3 * count(n) FILTER (n > 1) AS body_cells, 3 * count(n) FILTER (n = 1) AS header_cells, count(n) AS dependencies FROM u LEFT JOIN l USING (k) GROUP BY ALL",
    "priority": f"WITH {_STORE} SELECT ordinal, row_key, documentary_role_json, a AS Lugar_json, a0 AS Lugar_address, b AS Caso_json, b0 AS Caso_address, c AS Situacion_json, c0 AS Situacion_address, context_key, literal AS introduction_literal FROM ({_PIVOT}) WHERE k % 2 = 0",
    "regional": f"WITH {_STORE} SELECT ordinal, row_key, documentary_role_json, a AS category_json, b AS count_json, c AS percentage_json, context_key, literal AS caption_literal, unknown AS unknown_dependencies FROM ({_PIVOT}) WHERE k % 2 = 1",
    "dependencies": f"WITH {_STORE} SELECT unit_key, row_key || ':d' AS dependency_key, n AS ordinal, 'name' AS name, CASE WHEN s = 'O' THEN 'unknown' ELSE 'confirmed_none' END AS state, physical_page FROM l JOIN u USING (k)",
    "limits": f"""WITH {_STORE} SELECT 'scope' AS key, '"invented"' AS value_json UNION ALL SELECT 'unit:' || physical_page || x, '{{}}' FROM u, (VALUES (':provenance'), (':coverage-and-exposure'), (':permissions')) v(x)""",
    "trace": f"""WITH {_STORE}, x AS (SELECT c.*, l.f, l.row_key FROM c JOIN l USING (k, n) WHERE n > 1 ORDER BY k::VARCHAR, n, i LIMIT 1)
SELECT cell_key, 'object' AS value_type, '{{"l_returnflag":"' || f || '"}}' AS value_json, sha256(cell_key) AS document_sha256, '/0' AS pointer, NULL::VARCHAR AS historical_record_sha256, row_key || ':w' AS word_key, f AS text, '[0,1]' AS span_json, '[]' AS bbox_json, 'f' AS frame,
CASE WHEN n % 2 = 0 THEN 'evidence' END AS evidence_kind, CASE WHEN n % 2 = 0 THEN k || ':r' END AS evidence_address, 'x:' || k AS context_key, CASE WHEN k % 3 = 0 THEN k::VARCHAR END AS assertion_source, CASE WHEN k % 3 = 0 THEN '{{}}' END AS attribution_json, CASE WHEN k % 3 = 0 THEN 'absent' END AS stage_presence, NULL::VARCHAR AS stage_json FROM x""",
}


def _named(name):
    def f(spark, d):
        return store(spark, d).query(name)

    f.__name__ = f"inspect_{name}"
    return query(_SQL[name])(f)


for _name in _SQL:
    _named(_name)


@query(f"WITH {_STORE} SELECT cell_key, k || ':q' AS qualifier_key, 'note' AS kind, CASE WHEN k % 2 = 0 THEN 'table_proposal' ELSE 'column' END AS target_kind, CASE WHEN k % 2 = 0 THEN ['place_text', 'case_description', 'published_situation'][i + 1] ELSE ['category', 'count', 'percentage'][i + 1] END AS column_role FROM c WHERE n > 1 AND (k % 2 = 0 OR i = 1)")
def inspect_qualifiers(spark, d):
    return store(spark, d).cell_qualifiers()


@query(f"WITH {_STORE} SELECT cell_key, k::VARCHAR AS unit_key, 'x:' || k AS context_key, 'caption' AS kind FROM c")
def inspect_contexts(spark, d):
    return store(spark, d).cell_context()
