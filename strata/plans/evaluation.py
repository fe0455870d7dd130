"""Queries on metrics, comparison and the gate, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import metrics as M
from ..registry import query, table

_RATIO = "CASE WHEN {1} = 0 THEN 1.0 ELSE {0}::DOUBLE / {1} END"
_DETECT = f"tp::BIGINT AS true_positive, fp::BIGINT AS false_positive, fn::BIGINT AS false_negative, {_RATIO.format('tp', '(tp + fp)')} AS precision, {_RATIO.format('tp', '(tp + fn)')} AS recall"
_BAGS = """
g AS (SELECT o_orderpriority AS kind, o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT kind, a, b, sum(n) AS n FROM (
  SELECT o_orderpriority AS kind, o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY ALL
  UNION ALL SELECT o_orderpriority, o_orderstatus, o_orderpriority, count(*) FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL) GROUP BY ALL),
c AS (SELECT coalesce(g.kind, p.kind) AS kind, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM g FULL JOIN p ON g.kind = p.kind AND g.a = p.a AND g.b = p.b)"""
_SUMS = "sum(least(g, p)) AS tp, sum(greatest(p - g, 0)) AS fp, sum(greatest(g - p, 0)) AS fn"


def _objects(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    predicted = o.where("o_orderkey % 10 <> 0").unionByName(o.where("o_orderkey % 7 = 0"))
    return o, predicted


@query(f"WITH {_BAGS} SELECT {_DETECT} FROM (SELECT {_SUMS} FROM c)")
def bag_metrics(spark, d):
    gold, predicted = _objects(spark, d)
    return M.bag_metrics(gold, predicted, ["a", "b"])


@query(f"WITH {_BAGS}, s AS (SELECT kind, {_SUMS} FROM c GROUP BY kind) SELECT t.kind, {_DETECT.replace('tp', 'coalesce(tp, 0)').replace('fp', 'coalesce(fp, 0)').replace('fn::', 'coalesce(fn, 0)::').replace('+ fn)', '+ coalesce(fn, 0))')} FROM (SELECT DISTINCT o_orderpriority AS kind FROM orders UNION SELECT 'NONE') t LEFT JOIN s USING (kind)")
def object_type_metrics(spark, d):
    gold, predicted = _objects(spark, d)
    types = gold.select("kind").distinct().union(spark.createDataFrame([("NONE",)], "kind string"))
    return M.by_type(gold, predicted, types, "kind", ["a", "b"])


@query(f"WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 1000) SELECT {_DETECT} FROM (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL JOIN p USING (doc_id))")
def set_detection(spark, d):
    return M.set_metrics(table(spark, d, "labels").where("quality = 1"), table(spark, d, "documents").where("n_chars >= 1000"), ["doc_id"])


_SLOTS = """
g AS (SELECT o_orderkey AS unit, 'status' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
p AS (SELECT unit, field, CASE WHEN unit % 11 = 0 THEN 'X' ELSE v END AS v FROM g WHERE unit % 13 <> 0 UNION ALL SELECT -unit, field, v FROM g WHERE unit % 17 = 0),
c AS (SELECT g.unit IS NOT NULL AS g, p.unit IS NOT NULL AS p, g.v IS NOT DISTINCT FROM p.v AS eq FROM g FULL JOIN p ON g.unit = p.unit AND g.field = p.field)"""


def _slots(spark, d):
    o = table(spark, d, "orders")
    gold = o.select(F.col("o_orderkey").alias("unit"), F.expr("stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) AS (field, v)"))
    changed = gold.where("unit % 13 <> 0").withColumn("v", F.when(F.col("unit") % 11 == 0, "X").otherwise(F.col("v")))
    return gold, changed.unionByName(gold.where("unit % 17 = 0").withColumn("unit", -F.col("unit")))


@query(f"WITH {_SLOTS}, s AS (SELECT count(*) FILTER (g AND p AND eq) AS correct, count(*) FILTER (g AND p AND NOT eq) AS incorrect, count(*) FILTER (g AND NOT p) AS missing, count(*) FILTER (NOT g AND p) AS extra, count(*) FILTER (g) AS gold_total, count(*) FILTER (p) AS prediction_total FROM c) SELECT *, gold_total + extra AS strict_denominator, {_RATIO.format('correct', '(gold_total + extra)')} AS strict_exact_accuracy FROM s")
def strict_fields(spark, d):
    return M.strict_metrics(*_slots(spark, d), ["unit", "field"], ["v"])


@query(f"WITH {_SLOTS}, s AS (SELECT count(*) FILTER (g AND p AND eq) AS correct, count(*) FILTER (g) AS total FROM c) SELECT *, {_RATIO.format('correct', 'total')} AS accuracy FROM s")
def field_accuracy(spark, d):
    return M.gold_accuracy(*_slots(spark, d), ["unit", "field"], ["v"])


@query(f"WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS pages FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS pages FROM lineitem WHERE l_quantity < 49 GROUP BY 1), s AS (SELECT count(*) FILTER (g.pages = p.pages) AS correct, count(*) AS total FROM g LEFT JOIN p USING (l_orderkey)) SELECT *, {_RATIO.format('correct', 'total')} AS accuracy FROM s")
def page_accuracy(spark, d):
    of = lambda df: df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("pages"))
    lines = table(spark, d, "lineitem")
    return M.gold_accuracy(of(lines), of(lines.where("l_quantity < 49")), ["l_orderkey"], ["pages"])


@query(f"WITH s AS (SELECT count(*) FILTER (coalesce(toxic, 0) = 0) AS correct, count(*) AS total FROM labels) SELECT *, {_RATIO.format('correct', 'total')} AS accuracy FROM s")
def provenance_completeness(spark, d):
    return M.completeness(table(spark, d, "labels").select((F.coalesce("toxic", F.lit(0)) == 0).alias("ok")), "ok")


_AUDIT = """
WITH r AS (SELECT o_orderkey AS unit, o_orderkey % 50 AS rid, o_orderkey % 7 AS rn, [1, 2, 2] AS pages, ['A', 'N'] AS sections FROM orders),
a AS (SELECT l_orderkey AS unit, CASE WHEN l_quantity > 45 THEN -1 ELSE l_orderkey % 50 END AS rid, CASE WHEN l_quantity < 3 THEN NULL ELSE l_orderkey % 7 END AS rn,
  CASE WHEN l_discount > 0.09 THEN NULL WHEN l_tax > 0.07 THEN 'y' ELSE 'x' END AS sha, l_linenumber AS page,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN ' ' ELSE l_returnflag END AS section, l_linestatus = 'O' AS allowed, l_quantity <> 10 AS located FROM lineitem WHERE l_orderkey % 5 <> 0),
p AS (SELECT r.unit, any_value(r.pages) AS pages, count(a.unit) AS n, list(page) FILTER (a.unit IS NOT NULL) AS seen,
  count(*) FILTER (a.unit IS NOT NULL AND a.rid IS DISTINCT FROM r.rid) AS wrong_report_id, count(*) FILTER (a.unit IS NOT NULL AND a.rn IS DISTINCT FROM r.rn) AS wrong_report_number,
  count(*) FILTER (a.unit IS NOT NULL AND sha IS NULL) AS missing_source_sha, count(*) FILTER (sha IS NOT NULL AND sha <> 'x') AS wrong_source_sha,
  count(*) FILTER (a.unit IS NOT NULL AND trim(section) = '') AS missing_section, count(*) FILTER (a.unit IS NOT NULL AND trim(section) <> '' AND NOT list_contains(sections, section)) AS wrong_section,
  count(*) FILTER (a.unit IS NOT NULL AND NOT allowed) AS invalid_granularity, count(*) FILTER (a.unit IS NOT NULL AND NOT located) AS missing_required_locator
  FROM r LEFT JOIN a USING (unit) GROUP BY r.unit),
q AS (SELECT *, (n = 0)::BIGINT AS missing_evidence,
  CASE WHEN n = 0 THEN len(pages) ELSE list_sum(list_transform(list_distinct(pages), lambda x: greatest(0, len(list_filter(pages, lambda y: y = x)) - len(list_filter(seen, lambda y: y = x))))) END AS missing_pages,
  CASE WHEN n = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(seen), lambda x: greatest(0, len(list_filter(seen, lambda y: y = x)) - len(list_filter(pages, lambda y: y = x))))) END AS extra_pages FROM p)
SELECT count(*) FILTER (missing_evidence + wrong_report_id + wrong_report_number + missing_source_sha + wrong_source_sha + missing_pages + extra_pages + missing_section + wrong_section + missing_required_locator + invalid_granularity = 0) AS complete,
  count(*) AS total, complete::DOUBLE / total AS completeness, sum(missing_evidence)::BIGINT AS missing_evidence, sum(wrong_report_id)::BIGINT AS wrong_report_id, sum(wrong_report_number)::BIGINT AS wrong_report_number,
  sum(missing_source_sha)::BIGINT AS missing_source_sha, sum(wrong_source_sha)::BIGINT AS wrong_source_sha, sum(missing_pages)::BIGINT AS missing_pages, sum(extra_pages)::BIGINT AS extra_pages,
  sum(missing_section)::BIGINT AS missing_section, sum(wrong_section)::BIGINT AS wrong_section, sum(missing_required_locator)::BIGINT AS missing_required_locator, sum(invalid_granularity)::BIGINT AS invalid_granularity FROM q"""


@query(_AUDIT)
def evidence_audit(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    texts = lambda *x: F.array(*map(F.lit, x))
    need = o.select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 50).alias("report_id"), (F.col("o_orderkey") % 7).alias("report_number"), F.lit("x").alias("source_sha256"), texts(1, 2, 2).alias("pages"), texts("A", "N").alias("sections"), texts("O").alias("allowed_granularities"))
    anchors = l.where("l_orderkey % 5 <> 0").select(
        F.col("l_orderkey").alias("unit"), F.expr("if(l_quantity > 45, -1, l_orderkey % 50)").alias("report_id"), F.expr("if(l_quantity < 3, null, l_orderkey % 7)").alias("report_number"),
        F.expr("case when l_discount > 0.09 then null when l_tax > 0.07 then 'y' else 'x' end").alias("source_sha256"), F.col("l_linenumber").alias("page"),
        F.expr("if(l_linestatus = 'O' and l_quantity > 40, ' ', l_returnflag)").alias("section"), F.col("l_linestatus").alias("granularity"), (F.col("l_quantity") != 10).alias("located"),
    )
    return M.evidence_audit(need, anchors, ["unit"])


def _gate_sql():
    strict = f"(WITH {_SLOTS} SELECT count(*) FILTER (g AND p AND eq)::DOUBLE / (count(*) FILTER (g) + count(*) FILTER (NOT g AND p)) FROM c)"
    bag = lambda k: f"(WITH {_BAGS} SELECT sum(least(g, p))::DOUBLE / sum({k}) FROM c)"
    return f"""WITH t(metric_name, threshold, observed) AS (VALUES ('case_detection_precision', 0.8::DOUBLE, {bag('p')}), ('case_detection_recall', 0.9::DOUBLE, {bag('g')}),
      ('exact_page_attribution', 0.99::DOUBLE, NULL::DOUBLE), ('strict_source_value_accuracy', 0.99::DOUBLE, {strict}))
      SELECT *, observed IS NULL AS missing, coalesce(observed >= threshold, false) AS passed, 'MISSING_REQUIRED_METRICS' AS final_acceptance FROM t"""


@query(_gate_sql())
def acceptance_gate(spark, d):
    gold, predicted = _objects(spark, d)
    bag = M.bag_metrics(gold, predicted, ["a", "b"]).selectExpr("stack(2, 'case_detection_precision', precision, 'case_detection_recall', recall) AS (metric_name, observed)")
    strict = M.strict_metrics(*_slots(spark, d), ["unit", "field"], ["v"]).select(F.lit("strict_source_value_accuracy").alias("metric_name"), F.col("strict_exact_accuracy").alias("observed"))
    limits = [("case_detection_precision", 0.8), ("case_detection_recall", 0.9), ("exact_page_attribution", 0.99), ("strict_source_value_accuracy", 0.99)]
    return M.acceptance_gate(bag.union(strict), spark.createDataFrame(limits, "metric_name string, threshold double"))


# -- comparison -------------------------------------------------------------------

_AB = "a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 4 <> 0)"


def _ab(spark, d):
    c = table(spark, d, "customer")
    return c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_nationkey AS v"), c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS k", "if(c_custkey % 5 = 0, -1, c_nationkey) AS v")


@query(f"WITH {_AB} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a_only' WHEN a.k IS NULL THEN 'b_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'matched' ELSE 'boundary_disagreement' END AS class FROM a FULL JOIN b ON a.k = b.k")
def pair_compare(spark, d):
    return C.pair_compare(*_ab(spark, d), ["k"], ["v"])


_BUCKETS = """
WITH a AS (SELECT l_orderkey AS k, l_returnflag AS v FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey AS k, l_returnflag AS v FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 9 <> 0),
s AS (SELECT k, v, 1 AS s FROM a UNION ALL SELECT k, v, -1 FROM b), p AS (SELECT k, v, count(*) FILTER (s > 0) AS x, count(*) FILTER (s < 0) AS y FROM s GROUP BY k, v),
q AS (SELECT k, sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b, sum(greatest(x - y, 0))::BIGINT AS only_a, sum(greatest(y - x, 0))::BIGINT AS only_b FROM p GROUP BY k)
SELECT *, CASE WHEN n_b = 0 THEN 'unmatched_a' WHEN n_a = 0 THEN 'unmatched_b' WHEN only_a = 0 AND only_b = 0 THEN 'equal' WHEN n_a > 1 OR n_b > 1 THEN 'duplicate' ELSE 'different' END AS class FROM q"""


@query(_BUCKETS)
def bucket_compare(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_returnflag AS v", "l_linenumber")
    return C.bucket_compare(l.where("l_linenumber <= 3"), l.where("l_linenumber <= 4 AND k % 9 <> 0"), ["k"], "v")


@query("WITH c AS (SELECT o_orderkey, 'Z' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0) SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN c.o_orderkey IS NOT NULL THEN c.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, c.o_orderkey IS NOT NULL AS corrected FROM (SELECT o_orderkey, o_orderstatus FROM orders) o FULL JOIN c ON o.o_orderkey = c.o_orderkey")
def overlay_versions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 10 = 1").withColumn("o_orderstatus", F.lit("Z")).unionByName(o.where("o_orderkey % 50 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return C.overlay(o, changes, ["o_orderkey"])


@query("WITH a AS (SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_linenumber < 4), b AS (SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_linenumber > 2) SELECT *, 'extra' AS difference FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def bag_equality(spark, d):
    l = table(spark, d, "lineitem")
    return C.bag_difference(l.where("l_linenumber < 4").selectExpr("l_returnflag AS f", "l_linestatus AS s"), l.where("l_linenumber > 2").selectExpr("l_returnflag AS f", "l_linestatus AS s"))


@query("WITH u AS (SELECT o_orderkey, 1 AS w, 0 AS p FROM orders UNION ALL SELECT o_orderkey, 0, 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 0, 1 FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 20 <> 0) SELECT o_orderkey, sum(w)::BIGINT AS in_whole, sum(p)::BIGINT AS in_parts FROM u GROUP BY 1 HAVING sum(w) <> 1 OR sum(p) <> 1")
def key_partition(spark, d):
    o = table(spark, d, "orders")
    return C.partition_faults(o, [o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O' AND o_orderkey % 20 <> 0")], ["o_orderkey"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1")
def dup_detector(spark, d):
    return C.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def keep_first(spark, d):
    return C.keep_first(table(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def insert_once(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return C.insert_once(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"])


@query("SELECT 'missing' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'known', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def key_presence(spark, d):
    c, o = table(spark, d, "customer").selectExpr("c_custkey AS k"), table(spark, d, "orders").selectExpr("o_custkey AS k")
    return C.only_in(c, o, ["k"]).select(F.lit("missing").alias("side"), "k").unionByName(C.known_in(c, o, ["k"]).select(F.lit("known").alias("side"), "k"))


@query("WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 END AS supersedes FROM orders) SELECT id FROM s WHERE id NOT IN (SELECT supersedes FROM s WHERE supersedes IS NOT NULL)")
def current_submissions(spark, d):
    return C.current(table(spark, d, "orders").selectExpr("o_orderkey AS id", "if(o_orderkey % 4 = 0, o_orderkey - 1, null) AS supersedes"), "id", "supersedes").select("id")


@query("SELECT a.l_orderkey, a.l_quantity AS l_quantity_1, b.l_quantity AS l_quantity_2, c.l_quantity AS l_quantity_3 FROM (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b USING (l_orderkey) JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) c USING (l_orderkey)")
def role_pivot(spark, d):
    return C.role_pivot(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2, 3], ["l_quantity"])
