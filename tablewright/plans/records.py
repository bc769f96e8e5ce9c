"""Queries of filters, validation, projection, edits, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import predicates as P
from tablewright.operators import tables as R
from tablewright.plans.registry import query

C = F.col


@query("orders", "customer", sql="""
SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL ORDER BY segment, total DESC""")
def segment_leaderboard(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Filter, join, count and sum, two-key mixed sort."""
    rows = orders.where(C("o_orderstatus") != "P").join(customer, C("o_custkey") == C("c_custkey"))
    out = rows.groupBy(C("c_mktsegment").alias("segment"), C("o_orderpriority").alias("priority"))
    return out.agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("segment", F.desc("total"))


@query("part", sql="SELECT p_partkey, p_name, p_brand FROM part WHERE lower(coalesce(p_brand, 'none')) = lower('BRAND#12')")
def search_equal_ci(part: DataFrame) -> DataFrame:
    return part.where(P.equals_ci("p_brand", "BRAND#12")).select("p_partkey", "p_name", "p_brand")


@query("part", sql="""
SELECT p_partkey FROM part WHERE contains(lower(p_name), 'anvil') OR contains(lower(p_type), 'anvil')
OR list_contains(list_transform(string_split(p_name, ' '), lambda x: contains(lower(x), 'anvil')), true)""")
def search_any_field(part: DataFrame) -> DataFrame:
    rows = part.withColumn("tags", F.split("p_name", " "))
    return rows.where(P.search_any("  ANVIL ", ["p_name", "p_type"], "tags")).select("p_partkey")


@query("documents", sql="SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def search_documents(documents: DataFrame) -> DataFrame:
    return documents.where(P.search_any("License", ["text", "source"])).select("doc_id", "source")


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS in_range, l_discount >= 0.05 AND NOT l_returnflag = 'N' AS combined,
  l_returnflag < 'N' AS before_n, l_returnflag IN ('A', 'R') AS member, l_quantity * l_tax <> 0 AS truthy
FROM lineitem WHERE l_quantity >= 5 AND (l_tax > 0.01 OR l_linestatus = 'O') AND l_extendedprice <> -999""")
def filter_predicates(lineitem: DataFrame) -> DataFrame:
    """Thresholds, ranges, boolean grouping, membership, sentinels and truthiness."""
    rows = lineitem.where(P.at_least("l_quantity", 5) & ((C("l_tax") > 0.01) | (C("l_linestatus") == "O")) & (C("l_extendedprice") != -999))
    return rows.select(
        "l_orderkey", "l_linenumber", P.in_range("l_quantity", 10, 20).alias("in_range"),
        ((C("l_discount") >= 0.05) & ~(C("l_returnflag") == "N")).alias("combined"), (C("l_returnflag") < "N").alias("before_n"),
        P.one_of("l_returnflag", "A", "R").alias("member"), P.truthy(C("l_quantity") * C("l_tax"), "number").alias("truthy"),
    )


@query("documents", sql="""
SELECT doc_id, list_contains(flags, true) AS any_long, NOT list_contains(flags, false) AS all_long FROM (
  SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 12) AS flags FROM documents)""")
def quantifiers(documents: DataFrame) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return documents.select("doc_id", F.exists(words, lambda w: F.length(w) > 12).alias("any_long"), F.forall(words, lambda w: F.length(w) > 12).alias("all_long"))


_CUSTOMER_OK = "coalesce(c_acctbal BETWEEN 0 AND 9000, false) AND coalesce(length(c_name) <= 18, false) AND c_mktsegment IS NOT NULL AND c_mktsegment <> ''"


def _customer_ok():
    return P.validate([P.in_range("c_acctbal", 0, 9000), P.max_length("c_name", 18), P.required("c_mktsegment")])


@query("customer", sql=f"SELECT c_custkey, c_name, {_CUSTOMER_OK} AS ok FROM customer")
def validated_customers(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_name", _customer_ok().alias("ok"))


@query("customer", sql=f"SELECT count(*) AS total, count(*) FILTER ({_CUSTOMER_OK}) AS passed, count(*) FILTER (NOT ({_CUSTOMER_OK})) AS failed FROM customer")
def validation_report(customer: DataFrame) -> DataFrame:
    return P.report(customer, _customer_ok())


@query("customer", sql=f"SELECT c_custkey, c_name FROM customer WHERE NOT ({_CUSTOMER_OK})")
def rejected_customers(customer: DataFrame) -> DataFrame:
    return P.split_valid(customer, _customer_ok())[1].select("c_custkey", "c_name")


@query("orders", sql="""
SELECT o_orderkey, contains(o_orderpriority, '-') AS has_dash, regexp_full_match(o_orderstatus, '[A-Za-z0-9]+') AND length(o_orderstatus) >= 3 AS username,
  CASE WHEN regexp_full_match(split_part(o_orderpriority, '-', 1), ' *[0-9]+ *') THEN split_part(o_orderpriority, '-', 1)::DOUBLE END AS parsed,
  o_orderstatus IN ('F', 'O', 'P') AS known FROM orders""")
def value_checks(orders: DataFrame) -> DataFrame:
    """E-mail mark, user name, tolerant number and enumeration rules."""
    return orders.select(
        "o_orderkey", F.coalesce(C("o_orderpriority").contains("-"), F.lit(False)).alias("has_dash"), P.username_like(C("o_orderstatus")).alias("username"),
        P.positive_number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("parsed"), P.one_of("o_orderstatus", "F", "O", "P").alias("known"),
    )


@query("documents", "labels", sql="SELECT doc_id, CASE WHEN lang = 'en' THEN NOT quality = 1 ELSE quality = 1 END AS favorite FROM labels JOIN documents USING (doc_id)")
def catalog_toggle(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.join(documents, "doc_id").select("doc_id", "lang", (C("quality") == 1).alias("favorite"))
    return R.toggle(rows, "favorite", C("lang") == "en").select("doc_id", "favorite")


@query("documents", "labels", sql="""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)""")
def catalog_edit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    edits = labels.select("doc_id", F.when(C("toxic") == 1, "flagged").otherwise("").alias("lang"))
    return R.partial_update(documents.select("doc_id", "lang", "source"), edits, "doc_id", ["lang"])


@query("documents", "labels", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def catalog_delete(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return R.delete_keys(documents.select("doc_id", "lang"), labels.where("quality = 0"), "doc_id")


@query("nation", "region", sql="SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region")
def catalog_insert(nation: DataFrame, region: DataFrame) -> DataFrame:
    return R.insert(nation.select(C("n_nationkey").alias("k"), C("n_name").alias("name")), region.select((C("r_regionkey") + 1000).alias("k"), C("r_name").alias("name")))


@query("part", sql="""
SELECT dense_rank() OVER (ORDER BY p_brand) AS number, p_brand, p_partkey, p_name, p_size FROM part WHERE p_size > 10""")
def catalog_export(part: DataFrame) -> DataFrame:
    """The rows of a subset, each with the number of its category; categories are numbered by name."""
    rows = part.where("p_size > 10")
    numbers = R.numbered(rows.select("p_brand").distinct(), [C("p_brand")], "number")
    return rows.join(numbers, "p_brand").select("number", "p_brand", "p_partkey", "p_name", "p_size")


@query("lineitem", "part", sql="""
SELECT rank, t.l_partkey AS partkey, p_name, n FROM (
  SELECT l_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey) t
JOIN part ON t.l_partkey = p_partkey""")
def ranked_lookup(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """A ranked list, each entry looked up by key."""
    ranked = R.numbered(lineitem.groupBy(C("l_partkey").alias("partkey")).agg(F.count("*").alias("n")), [F.desc("n"), F.asc("partkey")], "rank")
    return ranked.join(part, C("partkey") == C("p_partkey")).select("rank", "partkey", "p_name", "n")


@query("lineitem", "part", sql="""
SELECT l_orderkey, round(sum(l_quantity * p_retailprice), 2) AS subtotal, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def order_totals(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Quantity times looked-up price, summed by order."""
    rows = lineitem.join(part, C("l_partkey") == C("p_partkey")).groupBy("l_orderkey")
    return rows.agg(F.round(F.sum(C("l_quantity") * C("p_retailprice")), 2).alias("subtotal"), F.count("*").alias("lines"))


@query("customer", sql="""
SELECT c_custkey, first_value(c_name) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS first_name FROM customer WHERE c_mktsegment IS NOT NULL""")
def join_first_match_ci(customer: DataFrame) -> DataFrame:
    """Each customer with the first one of its segment, whatever the case of the segment's name."""
    left = customer.select("c_custkey", F.lower("c_mktsegment").alias("a"))
    right = customer.select(C("c_custkey").alias("k"), C("c_name").alias("first_name"), F.upper("c_mktsegment").alias("b"))
    return R.join_ci(left, right, "a", "b", "k").select("c_custkey", "first_name")


@query("supplier", "nation", sql="SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON s_nationkey = n_nationkey")
def left_lookup_default(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    rows = supplier.select("s_suppkey", C("s_nationkey").alias("n_nationkey"))
    return R.lookup(rows, nation.where("n_regionkey > 1"), "n_nationkey", "n_name", "unknown").select("s_suppkey", "n_name")


@query("customer", "supplier", sql="""
SELECT c_name, s_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey DESC) AS n FROM supplier) USING (n)""")
def zip_join(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Side by side by place, up to the shorter."""
    out = R.zip_rows(customer.select("c_custkey", "c_name"), supplier.select("s_suppkey", "s_name"), [C("c_custkey")], [F.desc("s_suppkey")])
    return out.select("c_name", "s_name")


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.where("o_totalprice > 300000"), C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.where("o_totalprice > 300000"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("supplier", "nation", "region", sql="""
SELECT r_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def group_resolution(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Keys resolved to their group over two dimension tables."""
    rows = supplier.join(nation, C("s_nationkey") == C("n_nationkey")).join(region, C("n_regionkey") == C("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@query("customer", "supplier", sql="""
SELECT nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM
(SELECT c_nationkey AS nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN
(SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (nationkey)""")
def full_outer_merge(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    a = customer.where("c_acctbal > 9000").groupBy(C("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = supplier.where("s_acctbal > 5000").groupBy(C("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full_outer").select("nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("part", "lineitem", sql="SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'returned' ELSE 'clean' END AS state FROM part")
def flag_enrichment(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    keys = lineitem.where("l_returnflag = 'R'").select(C("l_partkey").alias("p_partkey"))
    return R.flagged(part.select("p_partkey"), keys, "p_partkey", "hit").select("p_partkey", F.when(C("hit"), "returned").otherwise("clean").alias("state"))


@query("lineitem", sql="""
SELECT coalesce(round(sum(l_quantity), 2), 0) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n, round(avg(l_quantity), 6) AS mean,
  round(sum(l_quantity * l_quantity), 2) AS squares, max(length(l_shipinstruct)) AS longest, coalesce(sum(l_quantity) FILTER (l_quantity < 0), 0) AS empty_sum
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipinstruct FROM lineitem)""")
def global_aggregates(lineitem: DataFrame) -> DataFrame:
    q = C("l_quantity")
    return lineitem.agg(
        F.coalesce(F.round(F.sum(q), 2), F.lit(0)).alias("total"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.sum(q * q), 2).alias("squares"),
        F.max(F.length(F.concat("l_returnflag", "l_linestatus"))).cast("long").alias("longest"), F.coalesce(F.sum(F.when(q < 0, q)), F.lit(0.0)).alias("empty_sum"),
    )


@query("lineitem", sql="""
SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS discounted, round(coalesce(sum(l_extendedprice) FILTER (l_tax > 0.04), 0), 2) AS taxed,
 count(DISTINCT l_suppkey) AS suppliers, bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY l_returnflag""")
def filtered_aggregates(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_returnflag").agg(
        F.count_if(C("l_discount") > 0.05).alias("discounted"), F.round(F.coalesce(F.sum(F.when(C("l_tax") > 0.04, C("l_extendedprice"))), F.lit(0.0)), 2).alias("taxed"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.bool_or(C("l_quantity") > 49).alias("any_large"), F.bool_and(C("l_quantity") > 0).alias("all_positive"),
    )


@query("events", sql="SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY first_seen")
def first_seen_distinct(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.min("event_id").alias("first_seen")).orderBy("first_seen")


@query("events", sql="SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY user_id")
def keyed_accumulate(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("embeddings", sql="SELECT sum(len(embedding))::BIGINT AS elements, count(*) AS rows_ FROM embeddings")
def nested_element_count(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.sum(F.size("embedding")).alias("elements"), F.count("*").alias("rows_"))


@query("nation", "region", sql="SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def string_aggregation(nation: DataFrame, region: DataFrame) -> DataFrame:
    rows = nation.join(region, C("n_regionkey") == C("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("orders", sql="""
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS call FROM orders""")
def running_total_per_customer(orders: DataFrame) -> DataFrame:
    """Running sum and call number of each customer."""
    order = [C("o_orderdate"), C("o_orderkey")]
    rows = R.running_total(orders, "o_totalprice", ["o_custkey"], order, "running")
    rows = R.numbered(rows, order, "call", ["o_custkey"])
    return rows.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"), C("call").cast("long").alias("call"))


@query("part", sql="SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS position FROM part")
def positions(part: DataFrame) -> DataFrame:
    return R.numbered(part.select("p_partkey", "p_name"), [C("p_name"), C("p_partkey")], "position", start=0).select("p_partkey", "position")


@query("part", "lineitem", sql="""
SELECT p_partkey, p_name, n, row_number() OVER (ORDER BY n DESC, p_name DESC, p_partkey) AS rank FROM (
 SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey ORDER BY n DESC, p_name DESC, p_partkey LIMIT 10""")
def ranked_parts_topk(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    counts = lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).join(part, C("l_partkey") == C("p_partkey"))
    order = [F.desc("n"), F.desc("p_name"), F.asc("p_partkey")]
    top = counts.orderBy(*order).limit(10)
    return R.numbered(top.select("p_partkey", "p_name", "n"), order, "rank")


@query("conversations", sql="""
SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def conversation_memory(conversations: DataFrame) -> DataFrame:
    """The last three turns of each conversation."""
    return R.last_n(conversations, 3, ["conv_id"], [F.desc("turn")])


@query("customer", sql="""
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5""")
def multi_key_slice(customer: DataFrame) -> DataFrame:
    """Mixed sort directions, then a slice."""
    return customer.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").offset(5).limit(20).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("part", sql="SELECT p_partkey, length(p_name) AS width FROM part ORDER BY length(p_name), p_partkey DESC")
def sort_by_length(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.length("p_name").cast("long").alias("width")).orderBy("width", F.desc("p_partkey"))


_SETS = "a AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 20), z AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_retailprice > 1500)"


@query("part", sql=f"""WITH {_SETS}
SELECT 'union' AS op, b FROM (SELECT b FROM a UNION SELECT b FROM z) UNION ALL SELECT 'both', b FROM (SELECT b FROM a INTERSECT SELECT b FROM z)
UNION ALL SELECT 'only_a', b FROM (SELECT b FROM a EXCEPT SELECT b FROM z)
UNION ALL SELECT 'one_side', b FROM ((SELECT b FROM a EXCEPT SELECT b FROM z) UNION (SELECT b FROM z EXCEPT SELECT b FROM a))""")
def brand_sets(part: DataFrame) -> DataFrame:
    """Union, intersection, difference and symmetric difference."""
    a, z = (part.where(w).select(C("p_brand").alias("b")).distinct() for w in ("p_size < 20", "p_retailprice > 1500"))
    parts = {"union": a.union(z).distinct(), "both": a.intersect(z), "only_a": a.subtract(z), "one_side": R.symmetric_difference(a, z)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("op"), "b")
        out = rows if out is None else out.union(rows)
    return out


@query("orders", "customer", sql="SELECT NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS is_subset")
def subset_check(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return R.is_subset(orders.select("o_custkey"), customer.select("c_custkey"))


@query("lineitem", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def revenue_rollup(lineitem: DataFrame) -> DataFrame:
    """Extension: subtotals."""
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"))
