"""Scalar, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.plans.registry import query


@query("""AND p AS (SELECT p_partkey AS v, p_retailprice AS a, p_retailprice * (1 + (p_partkey % 5) * 4e-7) AS b FROM part)
 SELECT v, a = b OR abs(a - b) < 1e-6 * greatest(abs(a), abs(b)) AS eq, a < b AND NOT (a = b OR abs(a - b) < 1e-6 * greatest(abs(a), abs(b))) AS lt FROM p""")
def fuzzy_compare(t):
    a, b = F.col("p_retailprice"), F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5) * F.lit(4e-7))
    return t.part.select(F.col("p_partkey").alias("v"), scalar.fuzzy_equal(a, b).alias("eq"), scalar.fuzzy_less(a, b).alias("lt"))


@query("SELECT p_partkey AS v FROM part WHERE p_name ILIKE '%a_e%'")
def glob_match(t):
    return t.part.where(scalar.glob(F.col("p_name"), "*A?e*", True)).select(F.col("p_partkey").alias("v"))


@query("AND b AS (SELECT o_orderkey AS id, (o_orderkey % 9)::INT AS a FROM orders) SELECT id, unnest([a, a + 2]) AS n FROM b UNION ALL SELECT id, a + 5 + i FROM b, range(0, 4) r(i)")
def parse_int_ranges(t):
    a = F.col("o_orderkey") % 9
    text = F.concat_ws(",", a, F.concat(F.lit(" "), a + 2), F.concat_ws("-", a + 5, a + 8))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.explode(scalar.int_ranges(text)).alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.page') AS has_page FROM events")
def json_extract(t):
    j = lambda p: F.get_json_object("props", p)
    return t.events.select("event_id", j("$.k").cast("bigint").alias("k"), j("$.page").isNotNull().alias("has_page"))


@query("SELECT p_partkey AS v FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unannotated_anti(t):
    return t.part.join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("v"))


@query("SELECT o_orderkey AS id, c_name AS name, c_custkey IS NOT NULL AS placed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0")
def placement_left_join(t):
    c = t.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey o_custkey", "c_name name", "true placed")
    return t.orders.join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), "name", F.coalesce("placed", F.lit(False)).alias("placed"))


@query("""AND a AS (SELECT p_partkey AS id, p_size AS x FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS x FROM part WHERE p_partkey % 4 <> 0)
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS what, a.x AS before, b.x AS after FROM a FULL JOIN b ON a.id = b.id WHERE a.x IS DISTINCT FROM b.x""")
def design_diff(t):
    a = t.part.where("p_partkey % 5 <> 0").selectExpr("p_partkey id", "p_size before", "true ina")
    b = t.part.where("p_partkey % 4 <> 0").selectExpr("p_partkey id", "if(p_partkey % 7 = 0, p_size + 1, p_size) after", "true inb")
    d = a.join(b, "id", "full_outer").where("not (before <=> after)")
    return d.select("id", F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").otherwise("changed").alias("what"), "before", "after")


@query("SELECT p_partkey AS v, 'bus' || (p_partkey // 8) AS bus, p_partkey % 8 AS bit FROM part")
def parse_bus(t):
    bus, bit = scalar.bus_parts(F.concat(F.lit("bus"), F.expr("p_partkey div 8"), F.lit("["), F.col("p_partkey") % 8, F.lit("]")))
    return t.part.select(F.col("p_partkey").alias("v"), bus.alias("bus"), bit.alias("bit"))


@query("SELECT p_partkey AS v, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE regexp_replace(printf('%.3f', p_retailprice), '\\.?0+$', '') END AS text FROM part")
def trimmed_numbers(t):
    return t.part.select(F.col("p_partkey").alias("v"), scalar.trim_zeros(F.format_string("%.3f", "p_retailprice")).alias("text"))


@query("SELECT p_partkey AS v, (p_partkey % 2 = 0 AND NOT p_partkey % 3 = 0) OR (p_partkey % 5 = 0) <> (p_partkey % 2 = 0) AS f FROM part")
def boolean_function(t):
    ports = {"A": F.col("p_partkey") % 2 == 0, "B": F.col("p_partkey") % 3 == 0, "C": F.col("p_partkey") % 5 == 0}
    return t.part.select(F.col("p_partkey").alias("v"), scalar.boolean_function("A & B' | C ^ A", ports).alias("f"))


@query("""AND s AS (SELECT s_suppkey AS v, s_name AS t FROM supplier),
 h AS (SELECT v, t, 0 AS i, 5381::BIGINT AS h FROM s UNION ALL SELECT v, t, i + 1, xor((h * 33) % 4294967296, ascii(substr(t, i + 1, 1))::BIGINT) FROM h WHERE i < length(t)) SELECT v, h AS hash FROM h WHERE i = length(t)""")
def string_hash(t):
    return t.supplier.select(F.col("s_suppkey").alias("v"), scalar.djb2_xor(F.col("s_name")).alias("hash"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, count(*)::BIGINT AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.grouping_id("l_returnflag", "l_linestatus").alias("level"))


@query("""SELECT p_partkey AS v, p_brand = 'Brand#13' AS equal, starts_with(p_name, 'c') AS prefix, lower(p_type) = 'economy' AS same_word, len(string_split(p_name, ' '))::INT AS words,
 regexp_full_match(substr(p_brand, 7), '[0-9]+') AS digits, rtrim(p_name || '  ') AS trimmed, coalesce(nullif(p_type, 'ECONOMY') < 'P', true) AS null_less FROM part""")
def string_tests(t):
    """Equality, prefix, case-insensitive equality, split, digits, trimmed end, comparison with nulls first."""
    return t.part.select(
        F.col("p_partkey").alias("v"), (F.col("p_brand") == "Brand#13").alias("equal"), F.startswith("p_name", F.lit("c")).alias("prefix"), (F.lower("p_type") == "economy").alias("same_word"),
        F.size(F.split("p_name", " ")).alias("words"), scalar.is_digits(F.substring("p_brand", 7, 9)).alias("digits"), scalar.trim_right(F.concat("p_name", F.lit("  "))).alias("trimmed"),
        F.coalesce(F.nullif(F.col("p_type"), F.lit("ECONOMY")) < "P", F.lit(True)).alias("null_less"),
    )


@query("SELECT p_partkey AS v, round(p_retailprice / 1e3, 6) AS kilo, round(p_retailprice * 1e-3, 6) AS milli, (p_partkey * 1000 // 2000)::BIGINT AS units FROM part")
def unit_scaling(t):
    price = F.col("p_retailprice")
    return t.part.select(F.col("p_partkey").alias("v"), F.round(scalar.to_user(price, "k"), 6).alias("kilo"), F.round(scalar.from_user(price, "m"), 6).alias("milli"), scalar.to_units(F.col("p_partkey"), 1000, 2000).alias("units"))


@query("SELECT p_partkey AS v, p_name AS text, to_base64(encode(p_name)) AS code FROM part")
def base64_decode(t):
    return t.part.select(F.col("p_partkey").alias("v"), F.unbase64(F.base64(F.encode("p_name", "utf-8"))).cast("string").alias("text"), F.base64(F.encode("p_name", "utf-8")).alias("code"))


@query("""AND d AS (SELECT p_partkey AS v, list_extract(['input', 'output', 'tristate', 'bidirect', 'power', 'ground'], (p_partkey % 6 + 1)::INT) AS d FROM part)
 SELECT v, d IN ('input', 'bidirect') AS is_in, d IN ('output', 'tristate', 'bidirect') AS is_out, d = 'tristate' AS is_tri, d IN ('power', 'ground') AS is_power FROM d""")
def port_directions(t):
    d = F.element_at(F.array(*[F.lit(x) for x in ("input", "output", "tristate", "bidirect", "power", "ground")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("v"), scalar.any_input(d).alias("is_in"), scalar.any_output(d).alias("is_out"), scalar.any_tristate(d).alias("is_tri"), scalar.power_or_ground(d).alias("is_power"))


@query("SELECT p_partkey AS v, p_size::VARCHAR AS size, p_partkey % 3 = 0 AS flag FROM part")
def key_value_pairs(t):
    text = F.concat(F.lit("size="), "p_size", F.lit(",flag="), F.when(F.col("p_partkey") % 3 == 0, " Yes").otherwise("off"))
    kv = scalar.key_values(text)
    return t.part.select(F.col("p_partkey").alias("v"), kv["size"].alias("size"), scalar.lenient_bool(kv["flag"]).alias("flag"))


@query("SELECT l_returnflag AS clock, l_linestatus AS edge, count(*)::BIGINT AS n, (SELECT count(*) FROM lineitem)::BIGINT AS mixed FROM lineitem GROUP BY 1, 2")
def clock_domains(t):
    """Rows of each domain key, and of the one key if domains may mix."""
    key = scalar.domain_key(F.col("l_returnflag"), F.col("l_linestatus"))
    own = t.lineitem.groupBy(key.alias("k")).agg(F.first("l_returnflag").alias("clock"), F.first("l_linestatus").alias("edge"), F.count("*").alias("n"))
    whole = t.lineitem.groupBy(scalar.domain_key(F.col("l_returnflag"), F.col("l_linestatus"), mix=True).alias("k")).agg(F.count("*").alias("mixed"))
    return own.crossJoin(F.broadcast(whole.select("mixed"))).select("clock", "edge", "n", "mixed")  # one row


@query("SELECT p_partkey AS v, greatest(p_size % 7, p_size % 5, p_size % 3)::INT AS pitch, 1::INT AS delay FROM part")
def pitch_and_unit_delay(t):
    return t.part.select(F.col("p_partkey").alias("v"), scalar.effective_pitch(*[F.col("p_size") % k for k in (7, 5, 3)]).alias("pitch"), F.lit(1).alias("delay"))


@query("SELECT l_orderkey AS e, list({'x': l_partkey % 100, 'y': l_partkey // 100, 'layer': l_linenumber} ORDER BY l_partkey % 100, l_partkey // 100, l_linenumber) AS places FROM lineitem GROUP BY 1")
def index_order(t):
    """Places of an order's lines in lexicographic order of (x, y, layer)."""
    place = F.struct((F.col("l_partkey") % 100).alias("x"), F.expr("l_partkey div 100").alias("y"), F.col("l_linenumber").alias("layer"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("e")).agg(F.array_sort(F.collect_list(place)).alias("places"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS different, 1::BIGINT AS least, count(*)::BIGINT AS most FROM part")
def shuffle_places(t):
    """A seeded shuffle gives each part a place of its own."""
    from netloom.operators.ordered import row_numbers

    own = row_numbers(t.part.select("p_partkey", scalar.shuffled(F.col("p_partkey"), 7).alias("k")), "k", "p_partkey")
    return own.agg(F.count("*").alias("n"), F.count_distinct("rn").alias("different"), F.min("rn").alias("least"), F.max("rn").alias("most"))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def merge_join(t):
    """Both sides sorted by the key and merged."""
    own = t.orders.selectExpr("o_orderkey l_orderkey", "o_orderstatus status").join(t.lineitem.hint("merge"), "l_orderkey")
    return own.groupBy("status").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT p_partkey AS v, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS member FROM part")
def set_membership(t):
    inside = t.lineitem.where("l_quantity > 45").selectExpr("l_partkey p_partkey", "true member").distinct()
    return t.part.join(inside, "p_partkey", "left").select(F.col("p_partkey").alias("v"), F.coalesce("member", F.lit(False)).alias("member"))
