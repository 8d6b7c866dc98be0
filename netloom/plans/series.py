"""Order-dependent queries: renumbering, runs, policies, chains, journals, as-of joins, activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import sequence
from netloom.operators.ordered import row_numbers
from netloom.plans.registry import query


@query("SELECT v, row_number() OVER (ORDER BY v) AS new_v FROM vertices WHERE v % 3 <> 0")
def dense_renumber(t):
    return row_numbers(t.h.vertices.where("v % 3 <> 0").select("v"), "v", name="new_v")


@query("""AND s AS (SELECT p_partkey // 50 AS grp, p_partkey AS pos, p_size % 4 <> 0 AS free FROM part), f AS (SELECT grp, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS k FROM s WHERE free),
 r AS (SELECT grp, max(n) AS n FROM (SELECT grp, k, count(*) AS n FROM f GROUP BY grp, k) GROUP BY grp) SELECT grp, coalesce(n, 0)::BIGINT AS longest FROM (SELECT DISTINCT grp FROM s) LEFT JOIN r USING (grp)""")
def max_contiguous_slots(t):
    return sequence.longest_run(t.part.selectExpr("p_partkey div 50 grp", "p_partkey pos", "p_size"), "grp", "pos", F.col("p_size") % 4 != 0)


def _metrics(t):
    return t.events.select(F.col("event_id").alias("pos"), F.col("event_type").alias("key"), "value")


@query("SELECT event_id AS pos, event_type AS key, value FROM events WHERE NOT regexp_matches(event_type, '^c') OR event_id = (SELECT min(event_id) FROM events WHERE regexp_matches(event_type, '^c'))")
def metrics_keep_first(t):
    return sequence.keep_edge(_metrics(t), "^c", True)


@query("SELECT event_id AS pos, event_type AS key, value FROM events WHERE NOT regexp_matches(event_type, '^c') OR event_id = (SELECT max(event_id) FROM events WHERE regexp_matches(event_type, '^c'))")
def metrics_keep_last(t):
    return sequence.keep_edge(_metrics(t), "^c", False)


@query("SELECT event_id AS pos, event_type AS key, value FROM events WHERE NOT regexp_matches(event_type, '^c')")
def metrics_remove(t):
    return _metrics(t).where(~F.col("key").rlike("^c"))


@query("""AND l(k, cap) AS (VALUES ('click', 50.0::DOUBLE), ('view', 60.0::DOUBLE), ('purchase', 5.0::DOUBLE)), a AS (SELECT event_type AS k, round(avg(value), 6) AS m FROM events GROUP BY 1)
 SELECT k, m, cap, m <= cap AS ok FROM a JOIN l USING (k)""")
def metric_limits(t):
    limits = t.spark.createDataFrame([("click", 50.0), ("view", 60.0), ("purchase", 5.0)], "k string, cap double")
    a = t.events.groupBy(F.col("event_type").alias("k")).agg(F.round(F.avg("value"), 6).alias("m"))
    return a.join(limits, "k").select("k", "m", "cap", (F.col("m") <= F.col("cap")).alias("ok"))


@query("""AND c AS (SELECT c_custkey AS cell, c_nationkey AS domain, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, c_custkey) - 1 AS rn FROM customer)
 SELECT cell, domain, (rn // 5)::BIGINT AS chain, (rn % 5)::BIGINT AS place FROM c""")
def scan_chain_assign(t):
    return sequence.scan_chains(t.customer.selectExpr("c_nationkey domain", "c_custkey % 3 = 0 falling", "c_custkey cell"), 5)


@query("""AND c AS (SELECT c_custkey AS cell, c_nationkey AS domain, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rn FROM customer)
 SELECT cell, domain, coalesce(lag(domain) OVER (PARTITION BY domain ORDER BY rn) IS NULL, true) AS header FROM c""")
def domain_headers(t):
    first = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    return t.customer.join(first, "c_nationkey").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("domain"), (F.col("c_custkey") == F.col("first")).alias("header"))


_JOURNAL = "j AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'set' END AS op, user_id AS obj, event_type AS field, value FROM events)"


def _journal(t):
    return t.events.selectExpr("event_id seq", "if(event_type = 'purchase', 'delete', 'set') op", "user_id obj", "event_type field", "value")


@query(f"""AND {_JOURNAL}, g AS (SELECT obj, max(seq) AS gone FROM j WHERE op = 'delete' GROUP BY obj)
 SELECT j.obj, field, arg_max(value, seq) AS value FROM j LEFT JOIN g ON g.obj = j.obj WHERE op = 'set' AND (gone IS NULL OR seq > gone) GROUP BY j.obj, field""")
def journal_replay(t):
    return sequence.replay(_journal(t))


@query("""AND v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'click')
 SELECT id, v.value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_value(t):
    left = t.events.where("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return sequence.asof(left, t.events.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def activity_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * i) MINUTE AS start, count(*)::BIGINT AS n FROM events, range(0, 2) r(i) GROUP BY 1")
def activity_sliding(t):
    return t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""AND g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def activity_session(t):
    w = F.session_window("ts", "6 hours").alias("w")
    return t.events.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("AND w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b, ts FROM events) SELECT user_id AS id, ts, event_type AS value FROM w WHERE b IS NULL OR b <> event_type")
def value_changes(t):
    c = sequence.changes(t.events.selectExpr("user_id id", "ts t", "event_type value"))
    return c.select("id", F.col("t").alias("ts"), "value")


@query("AND d AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, row_number() OVER (ORDER BY name) AS id FROM d")
def name_dictionary(t):
    return sequence.dictionary(t.part.select(F.col("p_brand").alias("name")), "name")


@query("AND p AS (SELECT p_partkey AS id, nullif(p_size % 3, 0) AS a, p_partkey % 7 AS b FROM part) SELECT id, row_number() OVER (ORDER BY a NULLS FIRST, b, id) AS place FROM p")
def null_first_pairs(t):
    own = t.part.selectExpr("p_partkey id", "coalesce(nullif(p_size % 3, 0), -1) * 100 + p_partkey % 7 k")
    return row_numbers(own, "k", "id", name="place").select("id", "place")


@query("SELECT p_brand AS g, list(p_partkey ORDER BY p_partkey) AS members FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand")
def group_remove_member(t):
    return sequence.remove_member(t.part.selectExpr("p_brand g", "p_partkey member"), t.part.where("p_partkey % 2 <> 0").selectExpr("p_partkey member"))


@query("SELECT p_brand AS g, count(*)::BIGINT AS n, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY p_brand")
def group_members(t):
    return t.part.groupBy(F.col("p_brand").alias("g")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("members"))


@query("SELECT date_trunc('day', ts) AS day, sum(value)::DOUBLE AS total FROM (SELECT ts, floor(value)::BIGINT AS value FROM events) GROUP BY 1", name="iteration_totals")
def iteration_totals(t):
    return t.events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.sum(F.floor("value")).cast("double").alias("total"))


@query("""AND c AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey >= 7 THEN o_orderkey // 7 - 1 END AS prev FROM orders), ends AS (SELECT node FROM c WHERE node NOT IN (SELECT prev FROM c WHERE prev IS NOT NULL)),
 w AS (SELECT node AS leaf, node, 0 AS hops FROM ends UNION ALL SELECT w.leaf, c.prev, hops + 1 FROM w JOIN c ON c.node = w.node WHERE c.prev IS NOT NULL) SELECT leaf, node, hops::INT AS hops FROM w""")
def path_trace(t):
    """The paths back from all orders that no other order names as its predecessor."""
    from netloom.operators.graph import climbs

    c = t.orders.selectExpr("o_orderkey node", "if(o_orderkey >= 7, o_orderkey div 7 - 1, null) parent")
    ends = c.select("node").join(c.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return climbs(c, ends).select(F.col("node").alias("leaf"), F.col("anc").alias("node"), F.col("up").alias("hops"))
