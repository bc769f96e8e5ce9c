"""Queries of string, number, date, array, map and JSON functions, of prices and of metering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import containers as B
from tablewright.functions import numbers as N
from tablewright.functions import strings as S
from tablewright.operators import predicates as P
from tablewright.plans.registry import query

C = F.col


@query("part", sql="""
SELECT p_partkey, length(p_name) AS width, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_name || ' ') AS trimmed, replace(p_name, ' ', '_') AS under,
 len(string_split(p_brand, '#')) AS parts, instr(p_name, 'e') - 1 AS first_e, starts_with(p_type, 'S') AS starts, p_name[1:3] AS head, right(p_name, 2) AS tail,
 (length(p_name) - length(replace(p_name, 'e', ''))) AS es, CASE WHEN length(p_name) <= 10 THEN p_name ELSE p_name[1:10] || '...' END AS short, repeat('ab', 2) AS twice,
 replace(lower(p_name), ' ', '-') AS slug, string_split(p_type || '.' || p_brand, '.')[-1] AS ext FROM part""")
def string_functions(part: DataFrame) -> DataFrame:
    name = C("p_name")
    return part.select(
        "p_partkey", F.length(name).cast("long").alias("width"), F.upper(name).alias("up"), F.lower("p_type").alias("low"),
        S.strip(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.replace(name, F.lit(" "), F.lit("_")).alias("under"),
        F.size(S.split_literal(C("p_brand"), "#")).cast("long").alias("parts"), S.find(name, "e").cast("long").alias("first_e"), C("p_type").startswith("S").alias("starts"),
        F.substring(name, 1, 3).alias("head"), F.right(name, F.lit(2)).alias("tail"), S.occurrences(name, "e").cast("long").alias("es"),
        S.truncate(name, 10).alias("short"), F.repeat(F.lit("ab"), 2).alias("twice"), S.slug(name).alias("slug"), S.extension(F.concat_ws(".", "p_type", "p_brand")).alias("ext"),
    )


@query("nation", sql="""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN n_name WHEN 2 THEN n_name || ' and b' ELSE n_name || ', b, and c' END AS phrase,
 'k=' || n_nationkey || '&n=' || n_name AS qs, regexp_full_match(n_name, '[0-9]+') AS digits FROM nation""")
def string_phrases(nation: DataFrame) -> DataFrame:
    """List phrases, query strings and character classes."""
    names = F.slice(F.array(C("n_name"), F.lit("b"), F.lit("c")), F.lit(1), C("n_nationkey") % 4)
    return nation.select(
        "n_nationkey", S.list_phrase(names).alias("phrase"),
        S.query_string(F.create_map(F.lit("k"), C("n_nationkey").cast("string"), F.lit("n"), C("n_name"))).alias("qs"), C("n_name").rlike(r"^[0-9]+\z").alias("digits"),
    )


@query("documents", sql=r"""
SELECT doc_id, len(w) AS n_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest, len(w) // 200 AS minutes FROM (
 SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') AS w FROM documents)""")
def document_word_stats(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", S.words(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"), N.reading_minutes(F.size("w")).alias("minutes"))


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS ratio, floor((l_linenumber - 5) / 3.0)::BIGINT AS fdiv, ((l_linenumber - 5) % 3 + 3) % 3 AS fmod,
 round(pow(l_quantity, 2), 4) AS sq, round(sqrt(l_extendedprice), 6) AS root, l_quantity::BIGINT AS whole FROM lineitem""")
def arithmetic(lineitem: DataFrame) -> DataFrame:
    n = C("l_linenumber") - 5
    return lineitem.select(
        "l_orderkey", "l_linenumber", (C("l_extendedprice") / C("l_quantity")).alias("ratio"), N.floor_div(n, F.lit(3)).alias("fdiv"), N.floor_mod(n, F.lit(3)).alias("fmod"),
        F.round(F.pow("l_quantity", F.lit(2)), 4).alias("sq"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"), C("l_quantity").cast("long").alias("whole"),
    )


@query("orders", sql="SELECT o_orderkey, CASE WHEN regexp_full_match(p, ' *[+-]?[0-9]+ *') THEN trim(p)::BIGINT END AS n, p AS raw FROM (SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS p FROM orders)")
def tolerant_parse(orders: DataFrame) -> DataFrame:
    p = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return orders.select("o_orderkey", N.parsed_int(p).alias("n"), p.alias("raw"))


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 20 THEN 'medium' WHEN l_quantity >= 10 THEN 'small' ELSE 'single' END AS tier,
 l_extendedprice * CASE WHEN l_quantity >= 40 THEN 0.9 WHEN l_quantity >= 20 THEN 0.95 ELSE 1.0 END::DOUBLE AS price,
 l_extendedprice * (CASE WHEN l_linestatus = 'O' THEN 1.25 ELSE 1.0 END)::DOUBLE * (CASE WHEN l_returnflag = 'A' THEN 0.85 ELSE 1.0 END)::DOUBLE AS adjusted FROM lineitem""")
def tiered_prices(lineitem: DataFrame) -> DataFrame:
    price = C("l_extendedprice")
    return lineitem.select(
        "l_orderkey", "l_linenumber", N.tier(C("l_quantity"), [(40, "bulk"), (20, "medium"), (10, "small")], "single").alias("tier"),
        (price * N.tier(C("l_quantity"), [(40, 0.9), (20, 0.95)], 1.0)).alias("price"),
        (N.surcharge_then_discount(price, C("l_linestatus") == "O", C("l_returnflag") == "A")).alias("adjusted"),
    )


@query("orders", sql="""
SELECT o_orderkey, o_totalprice * (CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.8 ELSE 1.0 END)::DOUBLE AS coupon, o_totalprice * 1.05::DOUBLE + 1.5 AS packed,
 o_totalprice * (CASE WHEN o_orderstatus = 'F' THEN 0.9 ELSE 1.0 END)::DOUBLE * (CASE WHEN o_totalprice > 200000 THEN 0.95 ELSE 1.0 END)::DOUBLE * 1.08::DOUBLE AS due FROM orders""")
def composed_prices(orders: DataFrame) -> DataFrame:
    """Coupons, packaging and a chain of reductions before tax."""
    code = F.when(C("o_orderstatus") == "F", "SAVE10").when(C("o_orderstatus") == "O", "SAVE20")
    return orders.select(
        "o_orderkey", N.coupon(C("o_totalprice"), code).alias("coupon"), N.packed_price(C("o_totalprice")).alias("packed"),
        (N.checkout(C("o_totalprice"), C("o_orderstatus") == "F", C("o_totalprice") > 200000, F.lit(False))).alias("due"),
    )


@query("supplier", sql="""
SELECT s_suppkey, round(g, 4) AS gross, round(g * (CASE WHEN g >= 30000 THEN 0.2 WHEN g >= 15000 THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS tax FROM (
 SELECT s_suppkey, b + CASE WHEN s_nationkey < 5 AND b >= 20000 THEN 2000 ELSE 0 END AS g FROM (
  SELECT *, least(h, 40) * r + greatest(h - 40, 0) * r * 1.5::DOUBLE AS b FROM (SELECT *, (s_suppkey % 60)::DOUBLE AS h, abs(s_acctbal) / 10 AS r FROM supplier)))""")
def payroll(supplier: DataFrame) -> DataFrame:
    """Overtime, bonus and tax in sequence."""
    gross = N.gross_pay((C("s_suppkey") % 60).cast("double"), F.abs("s_acctbal") / 10, C("s_nationkey") < 5)
    return supplier.select("s_suppkey", gross.alias("g")).select("s_suppkey", F.round("g", 4).alias("gross"), F.round(N.income_tax(C("g")), 4).alias("tax"))


@query("customer", sql="""
SELECT c_custkey, c_acctbal * 9 / 5 + 32 AS f, c_acctbal * 0.621371::DOUBLE AS miles, b AS bmi,
 CASE WHEN b >= 30 THEN 'obese' WHEN b >= 25 THEN 'overweight' WHEN b >= 18.5 THEN 'normal' ELSE 'underweight' END AS class,
 (10 * w + 6.25::DOUBLE * 170 - 5 * 30) * (CASE c_mktsegment WHEN 'BUILDING' THEN 1.55 ELSE 1.2 END)::DOUBLE AS calories,
 abs(c_acctbal) * 1.1::DOUBLE / greatest(c_nationkey, 1) AS share
FROM (SELECT *, (50 + c_custkey % 60)::DOUBLE AS w, (50 + c_custkey % 60) / (1.7::DOUBLE * 1.7::DOUBLE) AS b FROM customer)""")
def conversions(customer: DataFrame) -> DataFrame:
    """Dispatch-table conversions, body mass, calories and a split bill."""
    w = (50 + C("c_custkey") % 60).cast("double")
    b = N.bmi(w, F.lit(1.7))
    activity = F.when(C("c_mktsegment") == "BUILDING", "moderate").otherwise("unknown")
    return customer.select(
        "c_custkey", (N.CONVERT["c_to_f"](C("c_acctbal"))).alias("f"), (N.CONVERT["km_to_miles"](C("c_acctbal"))).alias("miles"),
        (b).alias("bmi"), N.bmi_class(b).alias("class"), (N.daily_calories(w, F.lit(170.0), F.lit(30.0), activity)).alias("calories"),
        (N.per_person(F.abs("c_acctbal"), F.lit(10.0), C("c_nationkey").cast("string"))).alias("share"),
    )


@query("orders", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, day(o_orderdate) AS day, right(strftime(o_orderdate, '%Y-%m-%d'), 2) AS tail FROM orders""")
def date_strings(orders: DataFrame) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", iso.alias("iso"), F.dayofmonth(F.to_date(iso)).cast("long").alias("day"), F.right(iso, F.lit(2)).alias("tail"))


@query("embeddings", sql="""
SELECT vec_id, round(embedding[1], 6) AS first, round(embedding[-1], 6) AS last, len(embedding) + 1 AS longer, round(list_max(embedding), 6) AS top,
 len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * 2)), 5) AS doubled FROM embeddings""")
def array_functions(embeddings: DataFrame) -> DataFrame:
    e = C("embedding")
    return embeddings.select(
        "vec_id", F.round(F.get(e, F.lit(0)), 6).alias("first"), F.round(F.element_at(e, -1), 6).alias("last"), F.size(F.array_append(e, F.lit(0.0).cast("float"))).cast("long").alias("longer"),
        F.round(F.array_max(e), 6).alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(F.aggregate(F.transform(F.slice(e, 1, 4), lambda x: x.cast("double") * 2), F.lit(0.0), lambda s, x: s + x), 5).alias("doubled"),
    )


@query("supplier", sql="""
SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 2 ELSE 1 END AS kept, CASE WHEN s_nationkey < 12 THEN 'right ' || s_suppkey ELSE s_name END AS right_wins, CASE WHEN s_nationkey < 12 THEN 2 ELSE 3 END AS merged_keys, s_nationkey AS nested, s_nationkey + 1 AS updated, s_suppkey % 2 = 0 AS has_key FROM supplier""")
def record_functions(supplier: DataFrame) -> DataFrame:
    """Maps and structs: filter, merge with the right winning, nested read and update, key tests."""
    m = F.create_map(F.lit("x"), C("s_nationkey"), F.lit("y"), F.lit(1))
    right = F.when(C("s_nationkey") < 12, F.create_map(F.lit("name"), F.concat(F.lit("right "), "s_suppkey"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    merged = B.merged(F.create_map(F.lit("name"), "s_name", F.lit("nation"), C("s_nationkey").cast("string")), right)
    nested = F.struct(F.struct(C("s_nationkey").alias("nation")).alias("at"))
    return supplier.select("s_suppkey", m.alias("m"), merged.alias("r"), nested.alias("n")).select(
        "s_suppkey", F.size(F.map_filter("m", lambda k, v: v < 12)).cast("long").alias("kept"), F.try_element_at("r", F.lit("name")).alias("right_wins"), F.size("r").cast("long").alias("merged_keys"),
        C("n.at.nation").alias("nested"), C("n").withField("at.nation", C("n.at.nation") + 1)["at"]["nation"].alias("updated"),
        F.map_contains_key(F.when(C("s_suppkey") % 2 == 0, F.create_map(F.lit("k"), F.lit(1))).otherwise(F.create_map(F.lit("z"), F.lit(1))), "k").alias("has_key"),
    )


@query("events", sql="SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, coalesce(props::JSON ->> '$.missing', 'none') AS missing FROM events")
def event_props_json(events: DataFrame) -> DataFrame:
    p = F.from_json("props", "k BIGINT, missing STRING")
    return events.select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@query("orders", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS merchant, CASE WHEN l_returnflag = 'N' THEN l_linestatus END AS recipient FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def nested_json_round_trip(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Records nested by order, written as JSON text, read by schema and exploded again."""
    item = F.struct("l_linenumber", "l_quantity", C("l_returnflag").alias("merchant"), F.when(C("l_returnflag") == "N", C("l_linestatus")).alias("recipient"))
    rows = lineitem.join(orders, C("l_orderkey") == C("o_orderkey")).groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    schema = "ARRAY<STRUCT<l_linenumber: INT, l_quantity: DOUBLE, merchant: STRING, recipient: STRING>>"
    return rows.select("l_orderkey", F.inline(F.from_json(F.to_json("items"), schema)))


_MODELS = [("small", 0.075, 0.30), ("medium", 0.15, 0.60), ("large", 2.0, 15.0)]


@query("documents", sql="""
SELECT *, input_cost + output_cost AS total_cost FROM (SELECT doc_id, model, t AS tokens, t / 1e6 * i AS input_cost, (t // 2) / 1e6 * o AS output_cost FROM
(SELECT doc_id, length(coalesce(text, '')) // 4 AS t FROM documents), (VALUES ('small', 0.075::DOUBLE, 0.3::DOUBLE), ('medium', 0.15, 0.6), ('large', 2, 15)) p(model, i, o))""")
def token_cost(documents: DataFrame) -> DataFrame:
    """Cost of each document by price set, input, output and total, not rounded; prices are three fixed rows."""
    prices = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(i).alias("i"), F.lit(o).alias("o")) for m, i, o in _MODELS)))
    rows = documents.select("doc_id", N.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), prices.alias("p"))
    costs = rows.select("doc_id", "p.model", "tokens", N.token_cost(C("tokens"), C("p.i")).alias("input_cost"), N.token_cost(F.floor(C("tokens") / 2), C("p.o")).alias("output_cost"))
    return costs.withColumn("total_cost", C("input_cost") + C("output_cost"))


@query("conversations", sql="""
SELECT conv_id, coalesce(sum(length(text) // 4) FILTER (role = 'user'), 0)::BIGINT AS input_tokens, coalesce(sum(length(text) // 4) FILTER (role <> 'user'), 0)::BIGINT AS output_tokens, count(*) AS turns
FROM conversations GROUP BY conv_id""")
def usage_receipt(conversations: DataFrame) -> DataFrame:
    t, user = N.estimated_tokens(C("text")), C("role") == "user"
    total = lambda test: F.coalesce(F.sum(F.when(test, t)), F.lit(0)).cast("long")
    return conversations.groupBy("conv_id").agg(total(user).alias("input_tokens"), total(~user).alias("output_tokens"), F.count("*").alias("turns"))


@query("part", sql="SELECT p_partkey, p_size * 4 AS twice, p_size + 6 AS added, CASE WHEN p_size % 2 = 0 THEN p_size + 3 ELSE p_size * 3 END AS dispatched FROM part")
def higher_order(part: DataFrame) -> DataFrame:
    """Functions of Columns applied twice, built with their parameter, and chosen from a table."""
    twice = lambda f: lambda x: f(f(x))
    adder = lambda n: lambda x: x + n
    table = {"add": adder(3), "times": lambda x: x * 3}
    size = C("p_size")
    return part.select("p_partkey", twice(lambda x: x * 2)(size).alias("twice"), twice(adder(3))(size).alias("added"), F.when(size % 2 == 0, table["add"](size)).otherwise(table["times"](size)).alias("dispatched"))


@query("events", sql="SELECT event_id, value > 0 AS ok, CASE WHEN value > 0 THEN value END AS safe FROM events")
def tolerant_values(events: DataFrame) -> DataFrame:
    """Bad values become null instead of failing the query; strict forms raise."""
    ok = F.coalesce(C("value") > 0, F.lit(False))
    return events.select("event_id", ok.alias("ok"), F.when(ok, P.checked(C("value"), C("value") > 0, "value must be positive")).alias("safe"))
