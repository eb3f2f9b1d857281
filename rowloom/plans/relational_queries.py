"""Queries over the relational tables. Regions, nations and suppliers stand for families, parents and leaves; orders for
occupations and parts for skills; each has the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

#: Rows of order lines that one task takes.
SHARE = 500_000

@query(
    "SELECT r_regionkey AS family_id, r_name AS family, n_nationkey AS parent_id, n_name AS parent, s_suppkey AS leaf_id, s_name AS leaf "
    "FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey"
)
def taxonomy_paths(spark, d):
    family, parent, leaf = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    paths = family.join(parent, F.col("n_regionkey") == F.col("r_regionkey")).join(leaf, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return paths.select(
        F.col("r_regionkey").alias("family_id"), F.col("r_name").alias("family"), F.col("n_nationkey").alias("parent_id"),
        F.col("n_name").alias("parent"), F.col("s_suppkey").alias("leaf_id"), F.col("s_name").alias("leaf"),
    )


@query(
    "SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
    "WHERE c_mktsegment = 'BUILDING'"
)
def left_chain_null_leaf(spark, d):
    core = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, d, "orders")
    return core.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderstatus")


@query(
    "WITH RECURSIVE edges AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 49), "
    "accepted AS (SELECT a, min(b) AS b FROM edges GROUP BY a HAVING count(*) = 1), "
    "walk(node, resolved, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL "
    "SELECT node, b, depth + 1 FROM walk JOIN accepted ON a = resolved WHERE depth < 8) "
    "SELECT node, resolved FROM walk LEFT JOIN accepted ON a = resolved WHERE a IS NULL"
)
def recursive_resolution(spark, d):
    edges = table(spark, d, "lineitem").where("l_linenumber = 7 and l_quantity >= 49").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return R.resolve(nodes, edges, "node", "a", "b")


@query(
    "SELECT p_brand, p_partkey, p_type, priority FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY priority DESC) AS r FROM "
    "(SELECT p_brand, p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 2 ELSE 1 END * 100 + p_size AS priority FROM part)) WHERE r = 1"
)
def best_priority_ties(spark, d):
    priority = F.when(F.col("p_type") == "ECONOMY", 3).when(F.col("p_type") == "PROMO", 2).otherwise(1) * 100 + F.col("p_size")
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_type", priority.alias("priority"))
    return R.best_with_ties(rows, ["p_brand"], "priority")


@query(
    "WITH oc AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), "
    "lc AS (SELECT o_custkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS still_open "
    "FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) "
    "SELECT c_custkey, coalesce(oc.n, 0) AS order_count, coalesce(returned, 0) AS returned_count, coalesce(still_open, 0) AS open_count, "
    "greatest(coalesce(returned, 0), coalesce(still_open, 0)) AS most FROM customer LEFT JOIN oc ON oc.o_custkey = c_custkey LEFT JOIN lc ON lc.o_custkey = c_custkey"
)
def preagg_coverage(spark, d):
    orders, lines = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    counts = orders.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"))
    flags = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("still_open")
    )
    base = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    joined = base.join(counts, "o_custkey", "left").join(flags, "o_custkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "c_custkey", zero("n").alias("order_count"), zero("returned").alias("returned_count"), zero("still_open").alias("open_count"),
        F.greatest(zero("returned"), zero("still_open")).alias("most"),
    )


@query(
    "SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem l ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS "
    "(SELECT 1 FROM orders o2 JOIN lineitem l2 ON l2.l_orderkey = o2.o_orderkey WHERE o2.o_orderpriority <> '1-URGENT' AND o2.o_custkey = orders.o_custkey AND l2.l_partkey = l.l_partkey)"
)
def required_not_possessed(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "o_orderpriority")
    required = pairs.where("o_orderpriority = '1-URGENT'").select("o_custkey", "l_partkey").distinct()
    return required.join(pairs.where("o_orderpriority <> '1-URGENT'"), ["o_custkey", "l_partkey"], "left_anti")


@query(
    "SELECT p_partkey, p_brand, round((p_retailprice - lo) / nullif(hi - lo, 0), 6) AS scaled FROM part JOIN "
    "(SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) ON b = p_brand WHERE p_type <> 'PROMO'"
)
def minmax_scaled(spark, d):
    part = table(spark, d, "part")
    scale = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    scaled = (F.col("p_retailprice") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return part.where("p_type <> 'PROMO'").join(scale, "p_brand").select("p_partkey", "p_brand", F.round(scaled, 6).alias("scaled"))


@query("SELECT r_name, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS nations, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_concat(spark, d):
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), " | ")
    return joined.groupBy("r_name").agg(names.alias("nations"), F.count(F.lit(1)).alias("n"))


@query(
    "WITH need AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01' AND l_quantity = 50), "
    "hits AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN need USING (l_partkey)), n AS (SELECT count(*) AS n FROM orders), "
    "w AS (SELECT l_partkey, 1 + ln((1 + (SELECT n FROM n)) / (1 + count(DISTINCT l_orderkey))) AS idf FROM hits GROUP BY 1), den AS (SELECT sum(idf) AS den FROM w) "
    "SELECT l_orderkey, round(sum(idf) / (SELECT den FROM den), 6) AS coverage, count(*) AS matched FROM hits JOIN w USING (l_partkey) GROUP BY 1 ORDER BY coverage DESC, l_orderkey LIMIT 20"
)
def idf_overlap_rank(spark, d):
    lines = table(spark, d, "lineitem")
    need = lines.where("l_shipdate >= timestamp_ntz '2000-06-01 00:00:00' and l_quantity = 50").select("l_partkey").distinct()
    hits = lines.select("l_orderkey", "l_partkey").join(need, "l_partkey").distinct()
    n = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))
    weights = hits.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("df")).crossJoin(F.broadcast(n)).select("l_partkey", R.idf(F.col("n"), F.col("df")).alias("idf"))
    den = weights.agg(F.sum("idf").alias("den"))
    ranked = hits.join(weights, "l_partkey").groupBy("l_orderkey").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("matched"))
    return ranked.crossJoin(F.broadcast(den)).select("l_orderkey", F.round(F.col("s") / F.col("den"), 6).alias("coverage"), "matched").orderBy(F.desc("coverage"), "l_orderkey").limit(20)


@query(
    "WITH m AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) + floor(value / 10) AS BIGINT) AS e FROM events), "
    "f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM m), "
    "g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS i FROM f), "
    "u AS (SELECT user_id, i, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i) "
    "SELECT user_id, count(*) AS n_islands, CAST(sum(e - s + 1) AS BIGINT) AS total FROM u GROUP BY user_id"
)
def interval_union(spark, d):
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    spans = table(spark, d, "events").select("user_id", hours.alias("s"), (hours + F.floor(F.col("value") / 10)).cast("long").alias("e"))
    islands = R.islands(spans, ["user_id"], "s", "e")
    return islands.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_islands"), F.sum(F.col("e") - F.col("s") + 1).alias("total"))


@query(
    "WITH m AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) + floor(value / 10) AS BIGINT) AS e FROM events WHERE value >= 0), "
    "f AS (SELECT *, CASE WHEN s <= 1 + max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM m), "
    "g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS i FROM f), "
    "u AS (SELECT user_id, i, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i) "
    "SELECT user_id, count(*) AS n_islands, CAST(sum(e - s + 1) AS BIGINT) AS total FROM u GROUP BY user_id"
)
def interval_union_adjacent(spark, d):
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    spans = table(spark, d, "events").where("value >= 0").select("user_id", hours.alias("s"), (hours + F.floor(F.col("value") / 10)).cast("long").alias("e"))
    islands = R.islands(spans, ["user_id"], "s", "e", adjacent=1)
    return islands.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_islands"), F.sum(F.col("e") - F.col("s") + 1).alias("total"))


@query(
    "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'click')) e "
    "WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.value > 95 AND p.user_id = e.user_id)"
)
def resume_append(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    done = events.where("event_type = 'purchase' and value > 95").select("user_id")
    fresh = R.first_by(events.where("event_type in ('view', 'click')"), ["user_id", "event_type"], F.col("event_id"))
    return fresh.join(done, "user_id", "left_anti").select("event_id", "user_id", "event_type")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 12 THEN '0_YEARS' WHEN l_quantity < 36 THEN '1_2_YEARS' WHEN l_quantity < 60 THEN '3_5_YEARS' "
    "WHEN l_quantity < 96 THEN '5_7_YEARS' ELSE '8_PLUS_YEARS' END AS bracket FROM lineitem"
)
def bracket_map(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.bracket(F.col("l_quantity")).alias("bracket"))


@query(
    "SELECT 'lineitem.l_orderkey' AS reference, count(*) AS broken FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL "
    "SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL "
    "SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL "
    "SELECT 'nation.n_regionkey', count(*) FROM nation WHERE n_regionkey IS NOT NULL AND n_regionkey NOT IN (SELECT r_regionkey FROM region)"
)
def fk_check(spark, d):
    checks = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("nation", "n_regionkey", "region", "r_regionkey")]
    out = None
    for child, key, parent, parent_key in checks:
        broken = R.broken_references(table(spark, d, child).select(key), table(spark, d, parent), key, parent_key)
        row = broken.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(f"{child}.{key}").alias("reference"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_partkey IS NULL")
def pk_check(spark, d):
    return R.repeated_keys(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def dedupe_first(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lower("role").alias("key"))
    return R.first_by(rows, ["conv_id", "key"], F.col("turn")).drop("key")


@query(
    "WITH s AS (SELECT doc_id, 'quality' AS source, CAST(quality AS DOUBLE) AS score, 0.6 AS w FROM labels UNION ALL SELECT doc_id, 'toxic', 1.0 - toxic, 0.3 FROM labels "
    "UNION ALL SELECT doc_id, 'length', least(1.0, n_chars / 5000.0), 0.1 FROM documents) "
    "SELECT doc_id, count(*) AS n_sources, round(greatest(0.0, least(1.0, CAST(sum(w * score) / sum(w) + 0.06 * (count(*) - 1) AS DOUBLE))), 6) AS fused FROM s GROUP BY doc_id"
)
def fusion_weighted(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    rows = (
        labels.select("doc_id", F.col("quality").cast("double").alias("score"), F.lit(0.6).alias("w"))
        .unionByName(labels.select("doc_id", (1.0 - F.col("toxic")).alias("score"), F.lit(0.3).alias("w")))
        .unionByName(docs.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), F.lit(0.1).alias("w")))
    )
    fused = F.sum(F.col("w") * F.col("score")) / F.sum("w") + 0.06 * (F.count(F.lit(1)) - 1)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sources"), F.round(R.clamp(fused), 6).alias("fused"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def distinct_per_key(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders"))


@query(
    "SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5"
)
def top_k_per_group(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return R.top_k(rows, ["c_mktsegment"], 5, F.col("c_acctbal").desc(), F.col("c_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 50"
)
def severity_order(spark, d):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy(severity, "o_orderkey").limit(50)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 20")
def skill_search(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%ring%")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query(
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') "
    "EXCEPT SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'"
)
def set_difference(spark, d):
    customer = table(spark, d, "customer")
    wanted = customer.where("c_acctbal > 0").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return wanted.select("c_custkey", "c_nationkey").subtract(customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_nationkey"))


@query("SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersection(spark, d):
    left = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    return left.intersect(table(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query(
    "WITH new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1) "
    "SELECT k, v, 'new' AS origin FROM new UNION ALL SELECT c_custkey, c_acctbal, 'old' FROM customer WHERE c_custkey NOT IN (SELECT k FROM new)"
)
def upsert_by_key(spark, d):
    new = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01 00:00:00'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return R.upsert(old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), ["k"])


@query(
    "SELECT p_partkey, concat('P', substr(sha256(concat_ws(chr(31), CAST(p_partkey AS VARCHAR), p_name, p_brand)), 1, 24)) AS part_key FROM part"
)
def content_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.content_key("P", F.col("p_partkey"), F.col("p_name"), F.col("p_brand")).alias("part_key"))


@query(
    "SELECT c_custkey, trim(regexp_replace(lower(replace(c_name || ' - ' || c_mktsegment, '-', ' ')), '\\s+', ' ', 'g')) AS name_key FROM customer"
)
def name_keys(spark, d):
    name = F.concat(F.col("c_name"), F.lit(" - "), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.name_key(name).alias("name_key"))


@query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)"
)
def json_field(spark, d):
    valid = F.try_parse_json("props").isNotNull()
    return table(spark, d, "events").where(valid).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) = 1 THEN max(l_extendedprice) ELSE 0.75 * max(CASE WHEN r = 1 THEN l_extendedprice END) + 0.25 * max(CASE WHEN r = 2 THEN l_extendedprice END) END, 4) AS score "
    "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) GROUP BY 1"
)
def top_two_mix(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    # the two best of a group by a group limit; no group is gathered
    two = R.top_k(lines, ["l_orderkey"], 2, F.col("l_extendedprice").desc()).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("first"), F.min("l_extendedprice").alias("second"))
    score = F.when(F.col("n") == 1, F.col("first")).otherwise(0.75 * F.col("first") + 0.25 * F.col("second"))
    return counts.join(two, "l_orderkey").select("l_orderkey", "n", F.round(score, 4).alias("score"))


@query(
    "WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(list(l_partkey))) AS held FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), "
    "b AS (SELECT s_nationkey, list_sort(list_distinct(list(l_partkey))) AS need FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 49 GROUP BY 1) "
    "SELECT k, round(len(list_intersect(held, need)) / nullif(len(need), 0), 6) AS ratio, CAST(len(need) - len(list_intersect(held, need)) AS BIGINT) AS missing FROM a JOIN customer ON c_custkey = k JOIN b ON s_nationkey = c_nationkey"
)
def match_ratio(spark, d):
    lines = table(spark, d, "lineitem")
    held = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), "l_partkey").distinct()
    need = table(spark, d, "supplier").join(lines.where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_partkey").distinct()
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("s_nationkey"))
    # pairs meet by nation and part, and only counts go on: no nation's needs are sent to each of its customers
    met = held.join(customer, "k").join(need, ["s_nationkey", "l_partkey"]).groupBy("k").agg(F.count(F.lit(1)).alias("both"))
    sizes = need.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("needed"))
    rows = customer.join(held.select("k").distinct(), "k", "left_semi").join(sizes, "s_nationkey").join(met, "k", "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return rows.select("k", F.round(F.col("both") / F.col("needed"), 6).alias("ratio"), (F.col("needed") - F.col("both")).alias("missing"))


@query(
    "SELECT n_nationkey, CAST(sum(CASE WHEN kind = 's' THEN 1 ELSE 0 END) AS BIGINT) AS suppliers, CAST(sum(CASE WHEN kind = 'c' THEN 1 ELSE 0 END) AS BIGINT) AS customers, "
    "CASE WHEN count(DISTINCT kind) > 1 THEN 'MIXED' ELSE min(kind) END AS state FROM nation JOIN (SELECT s_nationkey AS k, 's' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer) ON k = n_nationkey GROUP BY 1"
)
def state_fold(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("s").alias("kind"))
    rows = rows.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("c").alias("kind")))
    joined = table(spark, d, "nation").select("n_nationkey").join(rows, "n_nationkey")
    return joined.groupBy("n_nationkey").agg(
        F.count_if(F.col("kind") == "s").alias("suppliers"), F.count_if(F.col("kind") == "c").alias("customers"),
        F.when(F.countDistinct("kind") > 1, "MIXED").otherwise(F.min("kind")).alias("state"),
    )


@query(
    "SELECT user_id, CAST(sum(CASE WHEN event_type <> coalesce(before, event_type) THEN 1 ELSE 0 END) AS BIGINT) AS switches, CAST(count(*) AS BIGINT) AS n FROM "
    "(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1"
)
def column_switches(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("before", before)
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") != F.coalesce("before", "event_type")).alias("switches"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT user_id, record, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS record FROM "
    "(SELECT *, CASE WHEN a AND NOT coalesce(lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS opens FROM (SELECT *, event_type = 'signup' AS a FROM events))) GROUP BY 1, 2"
)
def anchored_records(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("a", F.col("event_type") == "signup")
    rows = rows.withColumn("opens", F.when(F.col("a") & ~F.coalesce(F.lag("a").over(order), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("record", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "record").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_custkey, list_sort(codes) AS codes FROM (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_BALANCE' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') THEN 'SEGMENT_NOT_ALLOWED' END, "
    "CASE WHEN length(c_name) < 3 THEN 'NAME_TOO_SHORT' END], lambda x: x IS NOT NULL) AS codes FROM customer) WHERE len(codes) > 0"
)
def input_violations(spark, d):
    codes = F.array(
        F.when(F.col("c_acctbal") < 0, "NEGATIVE_BALANCE"),
        F.when(~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "SEGMENT_NOT_ALLOWED"),
        F.when(F.length("c_name") < 3, "NAME_TOO_SHORT"),
    )
    rows = table(spark, d, "customer").select("c_custkey", F.array_sort(F.filter(codes, lambda c: c.isNotNull())).alias("codes"))
    return rows.where(F.size("codes") > 0)


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS median_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def median_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("median_quantity"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT DISTINCT c_custkey, n_regionkey, l_suppkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"
)
def six_way_paths(spark, d):
    customer, nation, orders = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "orders")
    lines, supplier = table(spark, d, "lineitem"), table(spark, d, "supplier")
    home = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    bought = home.join(orders.select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(lines.select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    local = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    return bought.join(local, ["l_suppkey", "c_nationkey"]).select("c_custkey", "n_regionkey", "l_suppkey").distinct()


@query(
    "WITH pairs AS (SELECT o_orderkey, p.p_partkey, p.p_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p.p_partkey = l_partkey), "
    "small AS (SELECT DISTINCT a.o_orderkey, a.p_partkey FROM pairs a JOIN pairs b ON a.o_orderkey = b.o_orderkey AND b.p_size > a.p_size + 20) "
    "SELECT o_orderkey, p_partkey, p_size FROM (SELECT DISTINCT * FROM pairs) q WHERE NOT EXISTS (SELECT 1 FROM small s WHERE s.o_orderkey = q.o_orderkey AND s.p_partkey = q.p_partkey)"
)
def subsumption_prune(spark, d):
    orders, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    # as many tasks as the rows need: a task's rows are as many whatever the table's size
    n = max(spark.sparkContext.defaultParallelism, -(-lines.count() // SHARE))
    sized = lines.join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    pairs = sized.repartition(n, "o_orderkey").join(orders.repartition(n, "o_orderkey"), "o_orderkey", "left_semi")
    # a broader row goes if its group holds one that is larger by more than 20: the group's largest decides
    most = pairs.withColumn("most", F.max("p_size").over(Window.partitionBy("o_orderkey")))
    return most.where(F.col("most") <= F.col("p_size") + 20).select("o_orderkey", "p_partkey", "p_size").distinct()
