"""Queries on order: windows, chains, gaps, offsets, prefixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query, table

_CHAIN = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(event_type || event_id::VARCHAR) AS own, event_id FROM events), c AS (SELECT *, lag(CASE WHEN event_id % 40 = 0 THEN 'broken' ELSE own END) OVER (PARTITION BY user_id ORDER BY n) AS previous FROM e)"


@query(f"WITH {_CHAIN}, x AS (SELECT user_id, n, own, previous, row_number() OVER (PARTITION BY user_id ORDER BY n) AS expected_sequence, lag(own) OVER (PARTITION BY user_id ORDER BY n) AS expected_previous FROM c) SELECT * FROM x WHERE n <> expected_sequence OR previous IS DISTINCT FROM expected_previous")
def chain_check(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w.orderBy("event_id")).alias("n"), F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("own"), "event_id")
    c = e.withColumn("previous", F.lag(F.when(F.col("event_id") % 40 == 0, "broken").otherwise(F.col("own"))).over(w.orderBy("n"))).drop("event_id")
    return W.chain_faults(c, ["user_id"], "n", "own", "previous")


@query("WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE (conv_id + turn) % 5 <> 0) SELECT * FROM t WHERE turn <> previous + 1")
def contiguity(spark, d):
    return W.contiguity_faults(table(spark, d, "conversations").where("(conv_id + turn) % 5 <> 0").select("conv_id", "turn"), ["conv_id"], "turn")


@query('SELECT conv_id, turn, start, start + length(text) AS "end" FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)')
def running_offset(spark, d):
    return W.running_offset(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "start", "end")


_SESSIONS = "g AS (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), m AS (SELECT user_id, median(gap) AS mid FROM g GROUP BY 1)"


@query(f"WITH {_SESSIONS} SELECT user_id, event_id, 1 + sum(coalesce(gap > 3 * mid, false)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g JOIN m USING (user_id)")
def sessions_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = g.withColumn("gap", F.col("t") - F.lag("t").over(w))
    g = g.join(g.groupBy("user_id").agg(F.median("gap").alias("mid")), "user_id")
    return W.islands(g, ["user_id"], ["t", "event_id"], F.col("gap") > 3 * F.col("mid")).select("user_id", "event_id", "island")


_SPANS = "s AS (SELECT l_suppkey, epoch(l_shipdate)::DOUBLE / 86400 AS a, epoch(l_shipdate)::DOUBLE / 86400 + l_quantity / 10 AS b FROM lineitem), f AS (SELECT l_suppkey, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start, a AS gap_end FROM s), g AS (SELECT * FROM f WHERE gap_end > gap_start)"


def _spans(spark, d):
    day = F.unix_timestamp("l_shipdate").cast("double") / 86400
    return table(spark, d, "lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity") / 10).alias("b"))


@query(f"WITH {_SPANS} SELECT l_suppkey, gap_start, gap_end FROM g")
def free_intervals(spark, d):
    return W.free_intervals(_spans(spark, d), ["l_suppkey"], "a", "b")


@query(f"WITH {_SPANS}, r AS (SELECT *, gap_end - gap_start AS width, row_number() OVER w AS nth, lead(gap_end - gap_start) OVER w AS next FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY gap_end - gap_start DESC, gap_start)) SELECT l_suppkey, CASE WHEN next IS NULL OR width - next > 1e-6 THEN gap_start END AS gap_start, CASE WHEN next IS NULL OR width - next > 1e-6 THEN gap_end END AS gap_end FROM r WHERE nth = 1")
def widest_gap(spark, d):
    return W.widest_gap(W.free_intervals(_spans(spark, d), ["l_suppkey"], "a", "b"), ["l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice + lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity)) / 2 AS boundary FROM lineitem")
def row_boundaries(spark, d):
    return W.boundaries(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_quantity"], "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "boundary")


@query("WITH x AS (SELECT user_id, event_id AS a, lead(event_id) OVER w AS n1, lead(event_id, 2) OVER w AS n2, lead(event_type) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, a, n1 AS b, 1 AS distance FROM x WHERE n1 IS NOT NULL UNION ALL SELECT user_id, a, n2, 2 FROM x WHERE n2 IS NOT NULL AND k = (SELECT min(event_type) FROM events)")
def neighbour_pairs(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))  # one row
    x = e.crossJoin(F.broadcast(kind)).withColumn("is", F.when(F.col("event_type") == F.col("k"), "yes"))
    return W.neighbour_pairs(x, ["user_id"], ["ts", "event_id"], "event_id", "is", "yes")


@query("WITH x AS (SELECT user_id, event_id, bool_or(value > 90) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events) SELECT user_id, event_id FROM x WHERE NOT coalesce(seen, false)")
def prefix_until(spark, d):
    return W.prefix_until(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 90).select("user_id", "event_id")


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) SELECT host, min(page_id) AS page_id FROM h GROUP BY host ORDER BY page_id LIMIT 24")
def first_seen_cap(spark, d):
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return W.first_seen(hosts, ["host"], ["page_id"], 24).select("host", "page_id")


@query("WITH r AS (SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS total FROM orders) SELECT o_custkey, o_orderkey, total::DOUBLE AS total, total <= 500000 AS within FROM r")
def byte_budget(spark, d):
    o = table(spark, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return W.running_total(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "amount", 500000).select("o_custkey", "o_orderkey", F.col("total").cast("double").alias("total"), "within")


_BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_quantity + 10 AS x1, l_discount * 100 AS y0, l_discount * 100 + 3 AS y1 FROM lineitem)"


@query(f"WITH {_BOXES} SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)")
def overlap_pairs(spark, d):
    b = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS x0", "l_quantity + 10 AS x1", "l_discount * 100 AS y0", "l_discount * 100 + 3 AS y1")
    return W.overlap_pairs(b, ["l_orderkey"], "l_linenumber")


@query("SELECT l_suppkey, median(l_quantity) AS median_height, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem GROUP BY 1")
def median_heights(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median_height"), F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_discount").alias("y0"), F.max("l_discount").alias("y1"))


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 1) SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'pinned' WHEN n <= 60 THEN 'shard-' || ((n - 1) % 3)::VARCHAR ELSE 'remainder' END AS shard FROM s")
def deterministic_shards(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select("doc_id")
    # only the first 60 are numbered: they are found by a top-k, and ids beyond the last of them need no order
    last = ids.orderBy("doc_id").limit(60).agg(F.max("doc_id").alias("last"))
    ids = ids.join(F.broadcast(last), on=F.lit(True))  # one row
    n = F.row_number().over(Window.orderBy("doc_id"))  # of 60 rows, and of ties with the last
    ids = ids.where("doc_id <= last").withColumn("n", n).unionByName(ids.where("doc_id > last").withColumn("n", F.lit(61)))
    return ids.select("doc_id", F.when(F.col("doc_id") % 29 == 0, "pinned").when(F.col("n") <= 60, F.concat(F.lit("shard-"), ((F.col("n") - 1) % 3).cast("string"))).otherwise("remainder").alias("shard"))


@query("WITH p AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id) SELECT conv_id, n, regexp_full_match(roles, '(user,assistant)(,user,assistant)*(,user)?|user') AS well_formed FROM p")
def event_grammar(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("n"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    return turns.select("conv_id", "n", roles.rlike("^((user,assistant)(,user,assistant)*(,user)?|user)$").alias("well_formed"))
