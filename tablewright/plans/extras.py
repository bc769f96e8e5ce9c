"""Queries of sets and lists in a column, formats, JSON updates, files written and read again, wrappers and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright import reliability as L
from tablewright.functions import containers as B
from tablewright.functions import strings as S
from tablewright.operators import predicates as P
from tablewright.operators import tables as R
from tablewright.plans.registry import ORACLE_SQL, QUERIES, query
from tablewright.sources import readers, scratch, sinks
from tablewright.streaming import streams as T

C = F.col


def _listed(items) -> F.Column:
    return F.array_join(items, "|")


@query("part", sql="""
WITH w AS (SELECT *, string_split(p_name, ' ') AS l FROM part),
s AS (SELECT *, CASE WHEN len(l) = 2 AND l[1] = l[2] THEN l[1:1] ELSE l END AS tags FROM w)
SELECT p_partkey, array_to_string(CASE WHEN list_contains(tags, 'widget') THEN tags ELSE list_append(tags, 'widget') END, '|') AS added,
 array_to_string(list_filter(tags, lambda x: x <> 'widget'), '|') AS discarded, array_to_string(tags[2:], '|') AS removed, len(tags) AS size, len(tags) = 0 AS is_empty FROM s""")
def set_edits(part: DataFrame) -> DataFrame:
    """Members added, discarded, and removed in the strict form that fails without the member."""
    tags = F.array_distinct(F.split("p_name", " "))
    rows = part.select("p_partkey", tags.alias("tags"))
    return rows.select(
        "p_partkey", _listed(B.added(C("tags"), F.lit("widget"))).alias("added"), _listed(B.discarded(C("tags"), F.lit("widget"))).alias("discarded"),
        _listed(B.removed(C("tags"), F.get("tags", F.lit(0)))).alias("removed"), F.size("tags").cast("long").alias("size"), (F.size("tags") == 0).alias("is_empty"),
    )


@query("part", sql="""
WITH s AS (SELECT *, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS l FROM part)
SELECT p_partkey, array_to_string(list_concat(list_append(l[1:1], 'x'), l[2:]), '|') AS inserted, array_to_string(l[2:], '|') AS removed, l[-1] AS popped, array_to_string(l[1:-2], '|') AS rest,
 l[1] AS first_popped FROM s""")
def list_edits(part: DataFrame) -> DataFrame:
    """Insert at a place, remove the first of a value, pop from either end."""
    rows = part.select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ").alias("l"))
    last, rest = B.popped(C("l"))
    return rows.select(
        "p_partkey", _listed(B.inserted(C("l"), 1, F.lit("x"))).alias("inserted"), _listed(B.without_first(C("l"), F.get("l", F.lit(0)))).alias("removed"),
        last.alias("popped"), _listed(rest).alias("rest"), B.popped(C("l"), 0)[0].alias("first_popped"),
    )


@query("customer", sql="""
SELECT c_custkey, c_name AS popped, coalesce(NULL, 'none') AS missing, 'nation=' || c_nationkey || '&segment=' || c_mktsegment AS rest,
 'c' || c_custkey AS first_wins, 2::BIGINT AS n_keys FROM customer WHERE c_mktsegment IS NOT NULL""")
def record_pop(customer: DataFrame) -> DataFrame:
    """A field taken out of a record and returned, with a default; a map from pairs of which the first of a key stays."""
    record = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("nation"), C("c_nationkey").cast("string"))
    rows = customer.where("c_mktsegment IS NOT NULL").select("c_custkey", record.alias("m"))
    value, rest = B.popped_key(C("m"), "name")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    first = B.map_first(F.array(pair("k", F.concat(F.lit("c"), "c_custkey")), pair("k", F.lit("later")), pair("z", F.lit("z"))))
    return rows.select(
        "c_custkey", value.alias("popped"), B.popped_key(C("m"), "phone", F.lit("none"))[0].alias("missing"), S.query_string(rest).alias("rest"),
        F.try_element_at(first, F.lit("k")).alias("first_wins"), F.size(first).cast("long").alias("n_keys"),
    )


@query("part", sql="""
SELECT p_type, string_agg(p_brand || '=' || n, '&' ORDER BY p_brand) AS counts FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type""")
def brand_counts_map(part: DataFrame) -> DataFrame:
    """A map of computed values by key for each group; a group holds one entry for each brand."""
    counts = part.groupBy("p_type", "p_brand").agg(F.count("*").cast("string").alias("n"))
    return counts.groupBy("p_type").agg(S.query_string(F.map_from_entries(F.collect_list(F.struct("p_brand", "n")))).alias("counts"))


@query("orders", sql="""
SELECT o_orderkey, printf('%.2f', o_totalprice) AS two, format('{:,.2f}', o_totalprice) AS grouped, format('{:,}', o_orderkey * 1000) AS whole, printf('%.1f', o_custkey / 2.0) AS one, printf('%.0f', o_custkey::DOUBLE) AS none FROM orders""")
def number_formats(orders: DataFrame) -> DataFrame:
    """Fixed decimals and commas between thousands."""
    return orders.select(
        "o_orderkey", S.fixed(C("o_totalprice"), 2).alias("two"), S.thousands(C("o_totalprice"), 2).alias("grouped"), S.thousands(C("o_orderkey") * 1000).alias("whole"),
        S.fixed(C("o_custkey") / 2.0, 1).alias("one"), S.fixed(C("o_custkey"), 0).alias("none"),
    )


@query("part", sql="SELECT p_partkey, round_even(p_size / 2.0, 0) AS half, round_even(p_size / 4.0, 1) AS quarter FROM part")
def ties_to_even(part: DataFrame) -> DataFrame:
    """Exact ties go to the even neighbour."""
    return part.select("p_partkey", F.bround(C("p_size") / 2.0, 0).alias("half"), F.bround(C("p_size") / 4.0, 1).alias("quarter"))


@query("events", sql="""
SELECT event_id, 'int' AS a, CASE WHEN value IS NULL THEN 'none' ELSE 'float' END AS b, CASE WHEN props IS NULL THEN 'none' ELSE 'str' END AS c, CASE WHEN value IS NULL THEN 'none' ELSE 'bool' END AS d,
 CASE WHEN ts IS NULL THEN 'none' ELSE 'date' END AS e, 'list' AS f, 'dict' AS g FROM events""")
def value_kinds(events: DataFrame) -> DataFrame:
    kinds = {"a": C("event_id"), "b": C("value"), "c": C("props"), "d": C("value") > 0, "e": C("ts"), "f": F.array("value"), "g": F.struct("value")}
    return events.select("event_id", *(B.kind(v).alias(k) for k, v in kinds.items()))


@query("events", sql="""
SELECT event_id, hour(ts)::VARCHAR || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS clock, (hour(ts) * 60 + minute(ts))::INTEGER AS minutes, NULL::INTEGER AS bad FROM events""")
def times_of_day(events: DataFrame) -> DataFrame:
    """Time of day as H:mm, read back as minutes; what is no time is null."""
    clock = S.clock_time(F.hour("ts") * 60 + F.minute("ts"))
    return events.select("event_id", clock.alias("clock"), S.minutes_of_day(clock).alias("minutes"), S.minutes_of_day(F.lit("24:00")).alias("bad"))


@query("customer", sql="""
SELECT c_custkey, 'user' || c_custkey AS name, 'n' || c_nationkey || '.example.com' AS domain, length('pw-' || c_custkey) >= 8 AS strong, true AS mail_ok FROM customer""")
def account_checks(customer: DataFrame) -> DataFrame:
    """Parts of an address, and rules for addresses and passwords."""
    mail = F.concat(F.lit("user"), "c_custkey", F.lit("@n"), "c_nationkey", F.lit(".example.com"))
    name, domain = S.email_parts(mail)
    return customer.select("c_custkey", name.alias("name"), domain.alias("domain"), P.password_like(F.concat(F.lit("pw-"), "c_custkey")).alias("strong"), P.email_like(mail).alias("mail_ok"))


@query("customer", sql="SELECT c_custkey, c_custkey::DOUBLE AS balance, try_cast(c_mktsegment AS INTEGER) AS segment, NULL::VARCHAR AS phone FROM customer")
def typed_records(customer: DataFrame) -> DataFrame:
    """Records of a typed model from columns of text; what is not of its type is null, a missing field too."""
    raw = customer.select(C("c_custkey").cast("string").alias("c_custkey"), C("c_custkey").cast("string").alias("balance"), C("c_mktsegment").alias("segment"), "c_name")
    return P.typed(raw, "c_custkey BIGINT NOT NULL, balance DOUBLE, segment INT, phone STRING", strict=False)


@query("lineitem", "part", sql="SELECT p_partkey, p_size FROM part WHERE p_size < 5 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def low_stock(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Listed parts of which less than five are left (their size stands for the stock)."""
    return R.low_stock(lineitem.where("l_returnflag = 'R'").select(C("l_partkey").alias("p_partkey")), part, "p_partkey", "p_size", 5)


@query("lineitem", sql="""
SELECT 'except' AS op, k, count(*) AS n FROM (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_partkey % 50 FROM lineitem WHERE l_returnflag = 'R') GROUP BY k
UNION ALL SELECT 'both', k, count(*) FROM (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_returnflag = 'N' INTERSECT ALL SELECT l_partkey % 50 FROM lineitem WHERE l_returnflag = 'R') GROUP BY k""")
def bag_sets(lineitem: DataFrame) -> DataFrame:
    """Difference and intersection that count how often a row occurs."""
    a, b = (lineitem.where(C("l_returnflag") == x).select((C("l_partkey") % 50).alias("k")) for x in "NR")
    parts = {"except": R.except_all(a, b), "both": R.intersect_all(a, b)}
    counted = [rows.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "k", "n") for name, rows in parts.items()]
    return counted[0].unionByName(counted[1])


@query("orders", sql="""
SELECT o_orderkey, dense_rank() OVER w AS price_rank, ntile(4) OVER w AS quarter, lead(o_orderkey) OVER w AS next_order,
 count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_ms(o_orderdate) // 86400000 RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS in_30_days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_extras(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    days = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("o_orderdate"))).rangeBetween(-30, 0)
    return orders.select(
        "o_orderkey", F.dense_rank().over(w).cast("long").alias("price_rank"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lead("o_orderkey").over(w).alias("next_order"),
        F.count("*").over(days).alias("in_30_days"),
    )


@query("events", sql="""
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(events: DataFrame) -> DataFrame:
    """Sessions of each user, closed by thirty minutes without an event."""
    return T.session_counts(events.withColumn("ts", C("ts").cast("timestamp")), "user_id")


@query("lineitem", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def quantity_cube(lineitem: DataFrame) -> DataFrame:
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("events", sql="""
SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, user_id AS added, len([(props::JSON ->> '$.k')::BIGINT, event_id]) AS history FROM events""")
def json_update(events: DataFrame) -> DataFrame:
    """A JSON document loaded, given a field and a longer list, and written as text again."""
    doc = F.from_json("props", "k BIGINT, history ARRAY<BIGINT>")
    new = doc.withField("user", C("user_id")).withField("history", F.array_append(F.coalesce(doc["history"], F.array(doc["k"])), C("event_id")))
    back = F.from_json(F.to_json(new), "k BIGINT, user BIGINT, history ARRAY<BIGINT>")
    return events.select("event_id", back.alias("b")).select("event_id", C("b.k").alias("k"), C("b.user").alias("added"), F.size("b.history").cast("long").alias("history"))


@query("lineitem", sql="""
WITH t AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18, 2)) AS s FROM lineitem GROUP BY 1), u AS (SELECT *, round(s * 0.1, 2) AS tip FROM t)
SELECT l_orderkey, 'Subtotal: ' || s::DECIMAL(38, 2) || chr(10) || 'Tip: ' || tip::DECIMAL(38, 2) || chr(10) || 'Total: ' || (s + tip)::DECIMAL(38, 2) AS summary FROM u""")
def receipt_summaries(lineitem: DataFrame) -> DataFrame:
    """A summary text of each bill, in exact money."""
    bills = lineitem.groupBy("l_orderkey").agg(F.sum(C("l_extendedprice").cast("decimal(18,2)")).alias("subtotal"))
    tip = F.round(C("subtotal") * F.lit(0.1).cast("decimal(2,1)"), 2)
    return bills.select("l_orderkey", sinks.bill_summary(C("subtotal"), tip).alias("summary"))


def _files(spark: SparkSession, label: str) -> str:
    return scratch.new_place(spark, label)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with a header and read back by schema, filtered in the scan."""
    place = _files(spark, "csv")
    readers.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(place)
    return readers.csv_records(spark, place, "s_suppkey BIGINT, s_name STRING, s_nationkey INT").where("s_nationkey > 10")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as JSON lines and read back by schema."""
    place = _files(spark, "json")
    sinks.write_json_lines(readers.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), place)
    return spark.read.json(place, schema="c_custkey BIGINT, c_name STRING, c_mktsegment STRING")


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to the pipe-delimited store and read back, in both versions."""
    part = readers.table(spark, sf_dir, "part")
    rows = part.select(C("p_name").alias("title"), C("p_type").alias("category"), F.concat("p_brand", F.lit(" | size "), "p_size").alias("prompt"), F.split("p_name", " ").alias("tags"), (C("p_size") > 25).alias("favorite"))
    out = None
    for version in (1, 2):
        place = _files(spark, f"store{version}")
        sinks.write_store(rows, place, version)
        found = readers.prompt_store(spark, place, version).select(F.lit(version).alias("version"), "title", "category", "prompt", _listed(C("tags")).alias("tags"), "favorite")
        out = found if out is None else out.unionByName(found)
    return out


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written twice, once as the first of an append and once repeated under its number, and read back."""
    place = _files(spark, "text")
    names = readers.table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("value"))
    for number in (0, 1, 1):
        sinks.append_lines(names, place, number)
    return readers.text_lines(spark, f"{place}/*").groupBy("value").agg(F.count("*").alias("n"))


def upsert_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replaced by key, the new version written beside the old one and then made current."""
    place = _files(spark, "upsert")
    nation = readers.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.write_version(nation, place)
    new = nation.where("n_nationkey < 5").withColumn("n_name", F.lower("n_name"))
    sinks.write_version(sinks.upsert(sinks.read_version(spark, place), new, "n_nationkey"), place)
    return sinks.read_version(spark, place)


def retried_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read that fails twice before it succeeds, timed, counted and retried."""
    failures = iter([OSError("first"), OSError("second")])

    @L.retried(3, OSError)
    @L.counted
    def read() -> DataFrame:
        for error in failures:
            raise error
        return readers.table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    return read().withColumn("calls", F.lit(read.__wrapped__.calls).cast("long"))


def udaf_and_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate of one's own, and a table function that gives several rows for one."""

    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return float(values.max() - values.min())

    @F.udtf(returnType="word STRING, place INT")
    class Words:
        def eval(self, text: str):
            for place, word in enumerate((text or "").split(" ")):
                yield word, place

    part = readers.table(spark, sf_dir, "part")
    spreads = part.groupBy("p_type").agg(F.round(spread("p_retailprice"), 4).alias("spread"))
    words = part.lateralJoin(Words(C("p_name").outer())).groupBy("p_type", "word").agg(F.count("*").alias("n"))
    return words.join(spreads, "p_type").select("p_type", "word", "n", "spread")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over a stream, each given once when the watermark has passed it; a last session may still be open."""
    return T.run_available(T.session_counts(T.with_event_time(T.stream_table(spark, sf_dir, "events"), late="0 seconds"), "user_id"), "append")


_STORE = "p_name AS title, p_type AS category, p_brand || ' | size ' || p_size AS prompt, replace(p_name, ' ', '|') AS tags, p_size > 25 AS favorite FROM part"
for _f, _sql in (
    (csv_round_trip, "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey > 10"),
    (json_round_trip, "SELECT c_custkey, c_name, c_mktsegment FROM customer"),
    (store_round_trip, f"SELECT 1 AS version, {_STORE} UNION ALL SELECT 2, {_STORE}"),
    (text_round_trip, "SELECT n_name AS value, 2 AS n FROM nation"),
    (upsert_round_trip, "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name FROM nation"),
    (retried_read, "SELECT r_regionkey, r_name, 3::BIGINT AS calls FROM region"),
    (udaf_and_udtf, """WITH w AS (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part), s AS (SELECT p_type, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY 1)
SELECT p_type, word, count(*) AS n, spread FROM w JOIN s USING (p_type) GROUP BY ALL"""),
    (stream_sessions, None),
):
    QUERIES[_f.__name__] = _f
    if _sql:
        ORACLE_SQL[_f.__name__] = _sql
