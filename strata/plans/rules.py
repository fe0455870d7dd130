"""Queries on constraints, ledgers, ids, JSON and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as V
from ..operators import ledger as L
from ..registry import query, table


@query("""SELECT 'acctbal_finite' AS rule_id, c_custkey::VARCHAR AS key, NULL::VARCHAR AS detail FROM customer WHERE c_acctbal < -900
UNION ALL SELECT 'segment_known', c_custkey::VARCHAR, NULL FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')
UNION ALL SELECT 'orders_customer', o_custkey::VARCHAR, NULL FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0))
UNION ALL SELECT 'line_unique', l_orderkey || '|' || l_linenumber, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'discount_within_tax', l_orderkey::VARCHAR, l_tax::VARCHAR FROM lineitem WHERE l_tax > 0.07 AND l_discount > 0.09""")
def violations(spark, d):
    c, o, l = (table(spark, d, n) for n in ("customer", "orders", "lineitem"))
    return V.together(
        V.row_rules(c, F.col("c_custkey"), {"acctbal_finite": F.col("c_acctbal") < -900, "segment_known": ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")}),
        V.references(o, "orders_customer", "o_custkey", c.where("c_custkey % 40 <> 0"), "c_custkey"),
        V.unique(l, "line_unique", ["l_orderkey", "l_linenumber"]),
        V.broken(l, "discount_within_tax", F.col("l_orderkey"), (F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.09), F.col("l_tax")),
    )


_STATE = "CASE o_orderkey % 5 WHEN 0 THEN 'observed' WHEN 1 THEN 'explicit_zero' WHEN 2 THEN 'not_reported' WHEN 3 THEN 'source_ambiguous' ELSE 'other' END"
_VALUE = "CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN o_orderstatus END"


@query(f"WITH s AS (SELECT o_orderkey, {_STATE} AS state, {_VALUE} AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE ' ' END AS comment FROM orders) SELECT o_orderkey, CASE WHEN state = 'observed' AND value IS NULL THEN 'a value is required' WHEN state = 'not_reported' AND value IS NOT NULL THEN 'a value is forbidden' WHEN state = 'explicit_zero' AND coalesce(value, '') <> '0' THEN 'zero is required' WHEN state = 'source_ambiguous' AND trim(comment) = '' THEN 'a comment is required' WHEN state = 'other' THEN 'unknown state' END AS fault FROM s")
def annotation_states(spark, d):
    s = table(spark, d, "orders").selectExpr("o_orderkey", f"{_STATE} AS state", f"{_VALUE} AS value", "if(o_orderkey % 2 = 0, 'c', ' ') AS comment")
    return s.select("o_orderkey", V.state_faults(F.col("state"), F.col("value"), F.col("comment")).alias("fault"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error, CASE event_id % 7 WHEN 0 THEN 503 WHEN 1 THEN 302 WHEN 2 THEN 404 ELSE 200 END AS status, value * 10 AS bytes, CASE WHEN event_id % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS type, event_id % 2 = 0 AS ok FROM events) SELECT event_id, CASE WHEN error IS NOT NULL THEN 'transport_error' WHEN status = 503 THEN 'transient_http' WHEN status = 302 AND ok THEN 'redirect' WHEN status = 302 THEN 'rejected_redirect' WHEN status <> 200 THEN 'http_error' WHEN bytes > 900 THEN 'body_size' WHEN type = 'text/html' THEN 'content_type' ELSE 'success' END AS outcome FROM e")
def attempt_outcomes(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "if(event_id % 11 = 0, 'timeout', null) AS error", "case event_id % 7 when 0 then 503 when 1 then 302 when 2 then 404 else 200 end AS status", "value * 10 AS bytes", "if(event_id % 5 = 0, 'text/html', 'application/pdf') AS type", "event_id % 2 = 0 AS ok")
    c = F.col
    return e.select("event_id", V.attempt_outcome(c("status"), c("error"), c("bytes"), c("type"), F.lit("%PDF-1.7"), c("ok"), 900).alias("outcome"))


_RECORDS = """r0 AS (SELECT user_id AS run_id, event_id, event_id // 2 AS a, event_id % 2 AS half, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
rec AS (SELECT run_id::VARCHAR AS run_id, sequence, 'a' || a || CASE WHEN half = 0 THEN '-start' ELSE '-finish' END AS record_id, CASE WHEN sequence = 1 AND run_id % 2 = 0 THEN 'run-opened' WHEN event_id % 60 = 59 THEN 'run-terminal' WHEN half = 0 THEN 'attempt-started' ELSE 'attempt-finished' END AS record_type,
 'a' || a AS attempt_id, CASE WHEN a % 3 = 0 THEN 'crash_unknown' ELSE 'success' END AS outcome, (a % 100)::BIGINT AS reserved_bytes, (a % 50)::BIGINT AS accepted_bytes FROM r0)"""


def _records(spark, d):
    from pyspark.sql import Window

    r = table(spark, d, "events").selectExpr("user_id", "event_id", "event_id div 2 AS a", "event_id % 2 AS half").withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return r.selectExpr(
        "cast(user_id AS string) AS run_id", "cast(sequence AS bigint) AS sequence", "concat('a', a, if(half = 0, '-start', '-finish')) AS record_id",
        "case when sequence = 1 and user_id % 2 = 0 then 'run-opened' when event_id % 60 = 59 then 'run-terminal' when half = 0 then 'attempt-started' else 'attempt-finished' end AS record_type",
        "concat('a', a) AS attempt_id", "if(a % 3 = 0, 'crash_unknown', 'success') AS outcome", "a % 100 AS reserved_bytes", "a % 50 AS accepted_bytes",
    )


@query(f"""WITH {_RECORDS}, n AS (SELECT *, coalesce(sum((record_type = 'run-terminal')::INT) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM rec),
p AS (SELECT *, coalesce(sum((record_type = 'attempt-started')::INT) OVER w, 0) AS starts, coalesce(sum((record_type = 'attempt-finished')::INT) OVER w, 0) AS ends FROM rec WINDOW w AS (PARTITION BY run_id, attempt_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'record_id_unique' AS rule_id, run_id || '|' || record_id AS key, count(*)::VARCHAR AS detail FROM rec GROUP BY run_id, record_id HAVING count(*) > 1
UNION ALL SELECT 'opened_first', run_id || '|' || record_id, NULL FROM n WHERE (record_type = 'run-opened') <> (sequence = 1)
UNION ALL SELECT 'nothing_after_terminal', run_id || '|' || record_id, NULL FROM n WHERE closed > 0
UNION ALL SELECT 'start_once', run_id || '|' || record_id, NULL FROM p WHERE record_type = 'attempt-started' AND starts > 0
UNION ALL SELECT 'finish_after_start', run_id || '|' || record_id, NULL FROM p WHERE record_type = 'attempt-finished' AND (starts <> 1 OR ends > 0)""")
def ledger_graph(spark, d):
    return L.graph_faults(_records(spark, d))


@query(f"WITH {_RECORDS}, f AS (SELECT run_id, attempt_id, CASE WHEN outcome <> 'crash_unknown' THEN accepted_bytes END AS known FROM rec WHERE record_type = 'attempt-finished') SELECT s.run_id, count(*) AS attempts, sum(coalesce(known, reserved_bytes))::BIGINT AS bytes, attempts <= 3 AND bytes <= 200 AS within FROM rec s LEFT JOIN f ON f.run_id = s.run_id AND f.attempt_id = s.attempt_id WHERE record_type = 'attempt-started' GROUP BY s.run_id")
def byte_reservation(spark, d):
    return L.reserved(_records(spark, d), 3, 200)


@query(f"WITH {_RECORDS}, u AS (SELECT run_id, attempt_id FROM rec s WHERE record_type = 'attempt-started' AND NOT EXISTS (SELECT 1 FROM rec f WHERE f.record_type = 'attempt-finished' AND f.run_id = s.run_id AND f.attempt_id = s.attempt_id)), x AS (SELECT run_id, attempt_id || '-finish' AS record_id, 'attempt-finished' AS record_type, attempt_id, 'crash_unknown' AS outcome FROM u UNION ALL SELECT run_id, attempt_id || '-issue', 'issue', attempt_id, 'crash_unknown' FROM u) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.run_id = x.run_id AND rec.record_id = x.record_id)")
def crash_reconciliation(spark, d):
    return L.reconciled(_records(spark, d))


_ACTIONS = "act AS (SELECT conv_id::VARCHAR AS run_id, turn AS sequence, 'x' || (turn // 2) AS action_id, CASE WHEN role = 'user' THEN 'STARTED' WHEN turn % 5 = 0 THEN 'UNKNOWN' ELSE 'COMPLETED' END AS state FROM conversations)"


def _actions(spark, d):
    return table(spark, d, "conversations").selectExpr("cast(conv_id AS string) AS run_id", "turn AS sequence", "concat('x', turn div 2) AS action_id", "case when role = 'user' then 'STARTED' when turn % 5 = 0 then 'UNKNOWN' else 'COMPLETED' end AS state")


@query(f"WITH {_ACTIONS}, o AS (SELECT *, coalesce(sum(CASE state WHEN 'STARTED' THEN 1 WHEN 'COMPLETED' THEN -1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS open_before FROM act) SELECT *, state = 'STARTED' AND open_before > 0 AS fault FROM o")
def action_states(spark, d):
    return L.open_actions(_actions(spark, d))


@query(f"WITH {_ACTIONS} SELECT run_id, action_id, arg_max(state, sequence) AS state FROM act GROUP BY 1, 2 HAVING arg_max(state, sequence) <> 'COMPLETED'")
def unresolved_actions(spark, d):
    return L.unresolved(_actions(spark, d))


@query("WITH e AS (SELECT user_id::VARCHAR AS run_id, event_id AS sequence, CASE WHEN event_type = (SELECT max(event_type) FROM events) AND event_id % 9 = 0 THEN 'stop' ELSE 'outcome' END AS kind, event_type AS check_id, CASE WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END AS result FROM events), last AS (SELECT run_id, check_id, arg_max(result, sequence) AS result FROM e WHERE kind = 'outcome' GROUP BY 1, 2), plan AS (SELECT DISTINCT event_type AS check_id FROM events), nr AS (SELECT r.run_id, list_sort(list(p.check_id)) AS not_run FROM (SELECT DISTINCT run_id FROM e) r, plan p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.run_id = r.run_id AND l.check_id = p.check_id) GROUP BY 1) SELECT e.run_id, bool_or(kind = 'stop') AS stopped, (SELECT count(*) FROM last l WHERE l.run_id = e.run_id AND result = 'PASS') AS passed, (SELECT count(*) FROM last l WHERE l.run_id = e.run_id AND result <> 'PASS') AS failed, coalesce(any_value(not_run), []) AS not_run FROM e LEFT JOIN nr USING (run_id) GROUP BY e.run_id")
def journal_replay(spark, d):
    ev = table(spark, d, "events")
    top = ev.agg(F.max("event_type").alias("top"))  # one row
    e = ev.crossJoin(F.broadcast(top)).selectExpr("cast(user_id AS string) AS run_id", "event_id AS sequence", "if(event_type = top and event_id % 9 = 0, 'stop', 'outcome') AS kind", "event_type AS check_id", "if(value > 50, 'PASS', 'FAIL') AS result")
    return L.journal(e, ev.select(F.col("event_type").alias("check_id")).distinct())


@query("SELECT event_id, 'event-' || left(sha256(concat_ws(chr(31), event_type, coalesce(CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR END, 'None'))), 20) AS short_id, sha256(event_type) AS digest FROM events")
def stable_ids(spark, d):
    return table(spark, d, "events").select("event_id", S.joined_id("event", F.col("event_type"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")), length=20).alias("short_id"), F.sha2("event_type", 256).alias("digest"))


@query("SELECT event_id, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN 'null' WHEN 2 THEN '\"0\"' WHEN 3 THEN '0' WHEN 4 THEN 'false' WHEN 5 THEN '[1, 2]' ELSE '\"\"' END::JSON AS j FROM events)")
def json_kinds(spark, d):
    text = F.expr("""case event_id % 7 when 0 then props when 1 then 'null' when 2 then '"0"' when 3 then '0' when 4 then 'false' when 5 then '[1, 2]' else '""' end""")
    return table(spark, d, "events").select("event_id", S.json_kind(text).alias("kind"))


@query("WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) SELECT event_id, key FROM k")
def json_members(spark, d):
    """Members of JSON objects as rows."""
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.explode(keys).alias("key"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS html, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS flat FROM documents")
def escaped_texts(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.html_escape(F.col("text")).alias("html"), S.clean_text(F.col("text")).alias("flat"))


@query("SELECT doc_id, array_length(string_split(text, chr(10))) AS lines, CASE WHEN contains(text, chr(10)) THEN position(chr(10) IN text) ELSE length(text) END AS second_line FROM documents WHERE contains(text, chr(10))")
def line_offsets(spark, d):
    t = table(spark, d, "documents").where("contains(text, '\n')")
    return t.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), S.offset_of(F.col("text"), F.lit(2), F.lit(1)).alias("second_line"))


@query("SELECT doc_id, [x FOR x IN ['license', 'password', 'public'] IF contains(lower(text), x)] AS claims FROM documents")
def unsafe_claims(spark, d):
    return table(spark, d, "documents").select("doc_id", V.unsafe_claims(F.col("text"), ["license", "password", "public"]).alias("claims"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, true AS valid, list_transform(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, INTERVAL 1 MONTH), lambda m: strftime(m, '%Y-%m')) AS grid FROM orders")
def periods(spark, d):
    p = F.date_format("o_orderdate", "yyyy-MM")
    last = F.date_format(F.add_months("o_orderdate", 2), "yyyy-MM")
    return table(spark, d, "orders").select("o_orderkey", p.alias("period"), S.is_period(p).alias("valid"), S.months(p, last).alias("grid"))


@query("WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS pages, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1) SELECT l_orderkey, pages = list_sort(list_distinct(pages)) AS pages_ok, len(list_distinct(parts)) <> len(parts) AS repeats, NOT list_has_any(pages, parts) AS disjoint FROM g")
def array_rules(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("pages"), F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    return g.select("l_orderkey", S.sorted_unique_pages(F.col("pages")).alias("pages_ok"), S.has_repeats(F.col("parts")).alias("repeats"), S.disjoint(F.col("pages"), F.col("parts")).alias("disjoint"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS y0, l_quantity + 10 AS y1, l_discount * 100 AS z0, l_discount * 100 + 12 AS z1 FROM lineitem) SELECT l_orderkey, l_linenumber, least(y1, z1) - greatest(y0, z0) >= 0.75 * least(y1 - y0, z1 - z0) AND abs((y0 + y1) / 2 - (z0 + z1) / 2) <= 0.25 * least(y1 - y0, z1 - z0) AS same, greatest(0, least(y1, z1) - greatest(y0, z0)) AS shared, y0 >= z0 AND y1 <= z1 AS inside FROM b")
def box_predicates(spark, d):
    b = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS y0", "l_quantity + 10 AS y1", "l_discount * 100 AS z0", "l_discount * 100 + 12 AS z1")
    y0, y1, z0, z1 = (F.col(c) for c in ("y0", "y1", "z0", "z1"))
    one = F.lit(0.0)
    return b.select("l_orderkey", "l_linenumber", S.same_line(y0, y1, z0, z1).alias("same"), S.overlap(y0, y1, z0, z1).alias("shared"), S.inside((one, y0, one, y1), (one, z0, one, z1)).alias("inside"))
