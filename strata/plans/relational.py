"""The named inspection queries over units (orders), rows and cells (lineitem), and the other joins, unions and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table


def _views(spark, d):
    """Units are orders, cells are their lines; a cell's class, role and links follow from its columns."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    units = o.select(F.col("o_orderkey").alias("unit_key"), F.col("o_orderpriority").alias("label"), "o_orderdate", F.col("o_custkey").alias("context_key"))
    cells = l.select(F.col("l_orderkey").alias("unit_key"), F.col("l_linenumber").alias("ordinal"), F.expr("if(l_returnflag = 'N', 'body', 'header')").alias("cell_class"), F.expr("if(l_linestatus = 'O', 'unknown', 'known')").alias("state"), (F.col("l_linenumber") % 3).alias("role"), "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("exact_text"))
    return units, cells


_VIEWS = """units AS (SELECT o_orderkey AS unit_key, o_orderpriority AS label, o_orderdate, o_custkey AS context_key FROM orders),
cells AS (SELECT l_orderkey AS unit_key, l_linenumber AS ordinal, CASE WHEN l_returnflag = 'N' THEN 'body' ELSE 'header' END AS cell_class, CASE WHEN l_linestatus = 'O' THEN 'unknown' ELSE 'known' END AS state,
  l_linenumber % 3 AS role, l_partkey, l_suppkey, l_returnflag || l_linestatus AS exact_text FROM lineitem)"""


@query(f"WITH {_VIEWS} SELECT unit_key, label, (SELECT count(*) FROM cells c WHERE c.unit_key = u.unit_key AND cell_class = 'body') AS body_cells, (SELECT count(*) FROM cells c WHERE c.unit_key = u.unit_key AND cell_class = 'header') AS header_cells, (SELECT count(*) FROM cells c WHERE c.unit_key = u.unit_key AND state = 'unknown') AS dependencies FROM units u")
def units_counts(spark, d):
    units, cells = _views(spark, d)
    n = lambda c: F.count_if(c)
    counts = cells.groupBy("unit_key").agg(n(F.col("cell_class") == "body").alias("body_cells"), n(F.col("cell_class") == "header").alias("header_cells"), n(F.col("state") == "unknown").alias("dependencies"))
    return units.select("unit_key", "label").join(counts, "unit_key", "left").fillna(0, ["body_cells", "header_cells", "dependencies"])


_PRIORITY = """, r AS (SELECT unit_key, max(CASE WHEN role = 1 THEN l_partkey END) AS place, max(CASE WHEN role = 2 THEN l_partkey END) AS "case", max(CASE WHEN role = 0 THEN l_partkey END) AS situation FROM cells WHERE ordinal <= 3 GROUP BY unit_key HAVING count(DISTINCT role) = 3)"""


@query(f"WITH {_VIEWS}{_PRIORITY} SELECT r.*, u.context_key, (SELECT string_agg(exact_text, chr(10) ORDER BY ordinal, exact_text) FROM cells c WHERE c.unit_key = r.unit_key) AS introduction_literal FROM r JOIN units u USING (unit_key)")
def priority_rows_view(spark, d):
    from ..operators.compare import role_pivot

    units, cells = _views(spark, d)
    wide = role_pivot(cells.where("ordinal <= 3"), ["unit_key"], "role", [1, 2, 0], ["l_partkey"])
    text = cells.groupBy("unit_key").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ordinal, exact_text))), x -> x.exact_text), '\n')").alias("introduction_literal"))
    return wide.selectExpr("unit_key", "l_partkey_1 AS place", "l_partkey_2 AS `case`", "l_partkey_0 AS situation").join(units.select("unit_key", "context_key"), "unit_key").join(text, "unit_key")


@query(f"WITH {_VIEWS}{_PRIORITY} SELECT r.unit_key, place AS category, situation AS percentage, coalesce((SELECT count(*) FROM cells c WHERE c.unit_key = r.unit_key AND state = 'unknown'), 0) AS unknown_dependencies FROM r")
def regional_rows_view(spark, d):
    from ..operators.compare import role_pivot

    units, cells = _views(spark, d)
    wide = role_pivot(cells.where("ordinal <= 3"), ["unit_key"], "role", [1, 2, 0], ["l_partkey"])
    open_ = cells.groupBy("unit_key").agg(F.count_if(F.col("state") == "unknown").alias("unknown_dependencies"))
    return wide.join(open_, "unit_key").selectExpr("unit_key", "l_partkey_1 AS category", "l_partkey_0 AS percentage", "unknown_dependencies")


@query(f"WITH {_VIEWS} SELECT unit_key, ordinal, state, label FROM cells JOIN units USING (unit_key) WHERE cell_class = 'header'")
def dependencies_view(spark, d):
    units, cells = _views(spark, d)
    return cells.where("cell_class = 'header'").join(units, "unit_key").select("unit_key", "ordinal", "state", "label")


@query("SELECT 'region' AS key, r_name AS value FROM region UNION ALL SELECT 'nation:' || n_regionkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'status', o_orderstatus FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'event', event_type FROM events WHERE value IS NOT NULL")
def limits_union(spark, d):
    of = lambda name, key, value, where="true": table(spark, d, name).where(where).selectExpr(f"{key} AS key", f"{value} AS value")
    return of("region", "'region'", "r_name").unionByName(of("nation", "concat('nation:', n_regionkey)", "n_name")).unionByName(of("orders", "'status'", "o_orderstatus", "o_orderkey % 7 = 0")).unionByName(of("events", "'event'", "event_type", "value IS NOT NULL"))


@query("SELECT o_orderkey, l_linenumber, p_name, s_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 LEFT JOIN supplier ON s_suppkey = l_suppkey")
def trace_fanout(spark, d):
    out = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(table(spark, d, "part").where("p_size > 25"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left").select("o_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY 1")
def ordered_concat(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("array_join(transform(array_sort(collect_list(struct(l_linenumber, concat(l_returnflag, l_linestatus) AS t))), x -> x.t), '\n')").alias("text"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' ORDER BY l_orderkey, l_linenumber LIMIT 1")
def first_cell(spark, d):
    """The first body cell: a query of one row."""
    return table(spark, d, "lineitem").where("l_returnflag = 'N'").orderBy("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey").limit(1)


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7")
def cell_by_key(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("strata_cells")
    table(spark, d, "part").createOrReplaceTempView("strata_parts")
    return spark.sql("SELECT l_orderkey, l_linenumber, p_name FROM strata_cells JOIN strata_parts ON p_partkey = l_partkey WHERE l_orderkey = :key", args={"key": 7})


@query("SELECT p_partkey, s_suppkey, CASE WHEN p_size > 45 THEN 'table' ELSE 'column' END AS target FROM part JOIN supplier ON p_partkey % 50 = s_suppkey % 50 AND (p_size > 45 OR (p_size <= 45 AND p_size % 25 = s_nationkey))")
def qualifier_join(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    on = (F.col("p_partkey") % 50 == F.col("s_suppkey") % 50) & ((F.col("p_size") > 45) | ((F.col("p_size") <= 45) & (F.col("p_size") % 25 == F.col("s_nationkey"))))
    return p.join(s, on).select("p_partkey", "s_suppkey", F.when(F.col("p_size") > 45, "table").otherwise("column").alias("target"))


@query("WITH m(ordinal, status) AS (VALUES (0, 'P'), (1, 'F'), (2, 'O')) SELECT o_orderkey, row_number() OVER (ORDER BY ordinal, o_orderkey) AS place FROM orders JOIN m ON status = o_orderstatus")
def manifest_order(spark, d):
    """Rows in the order that a manifest, a JSON array, gives; places count per status before, so no single task sorts all."""
    from pyspark.sql import Window

    manifest = spark.createDataFrame([('{"views":["P","F","O"]}',)], "value_json string").selectExpr("posexplode(from_json(value_json, 'views ARRAY<STRING>').views) AS (ordinal, status)")
    rows = table(spark, d, "orders").join(F.broadcast(manifest), F.col("o_orderstatus") == F.col("status"))  # a manifest of three views
    sizes = rows.groupBy("ordinal").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.ordinal") < F.col("a.ordinal"), "left").groupBy("a.ordinal").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("ordinal").orderBy("o_orderkey"))
    return rows.withColumn("nth", nth).join(F.broadcast(before), "ordinal").select("o_orderkey", (F.col("before") + F.col("nth")).alias("place"))


@query("WITH w AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS x FROM lineitem), c AS (SELECT o_orderkey AS k, (o_orderkey % 20)::DOUBLE AS lo, (o_orderkey % 20 + 15)::DOUBLE AS hi FROM orders) SELECT w.k, i, lo, hi FROM w JOIN c ON w.k = c.k AND lo <= x AND x < hi")
def interval_join(spark, d):
    w, c = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS i", "l_quantity AS x"), table(spark, d, "orders").selectExpr("o_orderkey AS k", "cast(o_orderkey % 20 AS double) AS lo", "cast(o_orderkey % 20 + 15 AS double) AS hi")
    return w.join(c, (w.k == c.k) & (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi"))).select(w.k, "i", "lo", "hi")


@query("WITH a(actor) AS (VALUES ('owner'), ('reader'), ('guest')), r AS (SELECT r_name AS resource, r_regionkey FROM region), o(operation) AS (VALUES ('read'), ('write'), ('list')) SELECT actor, resource, operation, CASE WHEN actor = 'owner' THEN 'allow' WHEN operation = 'write' THEN 'deny' WHEN actor = 'guest' AND r_regionkey > 2 THEN 'deny' ELSE 'allow' END AS expected FROM a, r, o")
def access_matrix(spark, d):
    """Every actor, resource and operation with what is expected: the product is the result."""
    of = lambda name, *x: spark.createDataFrame([(v,) for v in x], f"{name} string")
    grid = of("actor", "owner", "reader", "guest").crossJoin(table(spark, d, "region").select(F.col("r_name").alias("resource"), "r_regionkey")).crossJoin(of("operation", "read", "write", "list"))
    rule = F.when(F.col("actor") == "owner", "allow").when(F.col("operation") == "write", "deny").when((F.col("actor") == "guest") & (F.col("r_regionkey") > 2), "deny").otherwise("allow")
    return grid.select("actor", "resource", "operation", rule.alias("expected"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def status_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT o_custkey AS owner, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o_custkey AS owner, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(g.owner, h.owner) AS owner, coalesce(g.n, 0) AS count_a, coalesce(h.n, 0) AS count_b FROM g FULL JOIN h ON g.owner = h.owner WHERE coalesce(g.n, 0) <> coalesce(h.n, 0)")
def instance_count_mismatches(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("count_a"), F.count_if(F.col("o_orderstatus") == "O").alias("count_b"))
    return o.where("count_a <> count_b")


@query("WITH h AS (SELECT c_nationkey, sha256(c_name) AS h FROM customer) SELECT c_nationkey, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint FROM h GROUP BY 1")
def fingerprints(spark, d):
    h = table(spark, d, "customer").select("c_nationkey", F.sha2("c_name", 256).alias("h"))
    return h.groupBy("c_nationkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("fingerprint"))


@query("SELECT c_nationkey, bool_and(c_acctbal > -900) AS all_ok, bool_or(c_acctbal < 0) AS any_low, coalesce(bool_and(c_acctbal > 0) FILTER (c_mktsegment = 'NONE'), true) AS all_of_none FROM customer GROUP BY 1")
def any_all(spark, d):
    none = F.when(F.col("c_mktsegment") == "NONE", F.col("c_acctbal") > 0)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.bool_and(F.col("c_acctbal") > -900).alias("all_ok"), F.bool_or(F.col("c_acctbal") < 0).alias("any_low"), F.coalesce(F.bool_and(none), F.lit(True)).alias("all_of_none"))


@query("SELECT lower(left(c_mktsegment, 4)) AS name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def case_insensitive_inventory(spark, d):
    return table(spark, d, "customer").groupBy(F.lower(F.substring("c_mktsegment", 1, 4)).alias("name")).agg(F.count("*").alias("n")).where("n > 1")
