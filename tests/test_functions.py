import pytest
from pyspark.sql import functions as F

from tablewright.functions import numbers as N
from tablewright.functions import strings as S
from tablewright.operators import predicates as P
from tablewright.operators import tables as T
from tablewright.operators import text as X


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_strings(spark):
    t = F.lit
    assert one(spark, S.title_case(t("o'neil mary-ann")), S.strip(t("\t a \n")), S.find(t("hay"), "z"), S.occurrences(t("aaaaa"), "aa")) == ("O'Neil Mary-Ann", "a", -1, 2)
    assert one(spark, S.split_literal(t("a.b"), "."), S.words(t("  ")), S.truncate(t("x" * 151), 150, 147)) == (["a", "b"], [], "x" * 147 + "...")
    assert one(spark, S.slug(t("Hello  There!")), S.initials(t("ann lee"), t("it desk")), S.extension(t("a.tar.gz"))) == ("hello-there", "AL-IT_DESK", "gz")
    phrases = [F.array(*map(t, x)) if x else F.array().cast("array<string>") for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])]
    assert one(spark, *map(S.list_phrase, phrases)) == ("", "a", "a and b", "a, b, and c")


def test_numbers(spark):
    t = F.lit
    assert one(spark, N.floor_div(t(-7), t(2)), N.floor_mod(t(-7), t(2)), N.parsed_int(t(" 12 ")), N.parsed_int(t("12.0"))) == (-4, 1, 12, None)
    assert one(spark, N.per_person(t(90.0), t(10.0), t("x")), N.per_person(t(90.0), t(0.0), t("-3"))) == pytest.approx((99.0, 90.0))
    assert one(spark, N.coupon(t(100.0), t("SAVE20")), N.gross_pay(t(50.0), t(10.0), t(False)), N.bmi_class(t(18.5))) == (80.0, 550.0, "normal")
    with pytest.raises(Exception):
        one(spark, N.daily_calories(t(70.0), t(170.0), t(30.0), t("flying"), strict=True))
    assert [round(one(spark, N.token_cost(t(n), t(p)))[0], 6) for n, p in ((65, 0.075), (82, 0.30), (65, 2.0))] == [0.000005, 0.000025, 0.00013]


def test_predicates_are_never_null(spark):
    df = spark.createDataFrame([(1, "Ann", 17, "abc"), (2, "", 18, "a b"), (3, None, None, None), (4, "Bo", 65, "x" * 13)], "id INT, name STRING, age INT, user STRING")
    ok = P.validate([P.in_range("age", 18, 65), P.max_length("user", 12), P.required("name")])
    assert [r[0] for r in df.select(ok).collect()] == [False, False, False, False]
    assert tuple(P.report(df, P.in_range("age", 18, 65)).first()) == (4, 2, 2)
    assert tuple(P.report(df, P.validate([])).first()) == (4, 4, 0)
    assert df.where(P.equals_ci("name", "NONE")).count() == 1
    assert df.where(P.search_any(" AN ", ["name", "user"])).count() == 1
    assert [r[0] for r in df.select(P.username_like(F.col("user"))).collect()] == [True, False, False, True]
    assert one(spark, P.positive_number(F.lit("12.5")), P.positive_number(F.lit("-1")), P.positive_number(F.lit("x")), P.positive_number(F.lit(None).cast("string"))) == (12.5, None, None, None)
    with pytest.raises(Exception):
        df.select(P.checked(F.col("age"), F.col("age") > 17, "too young")).collect()


def test_tables(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k LONG, v STRING")
    assert [tuple(r) for r in T.numbered(df, [F.col("k")], "n").orderBy("n").collect()] == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert T.numbered(df.where("k > 9"), [F.col("k")], "n").collect() == []
    edits = spark.createDataFrame([(1, ""), (2, "z")], "k LONG, v STRING")
    assert sorted(map(tuple, T.partial_update(df, edits, "k", ["v"]).collect())) == [(1, "a"), (2, "z"), (3, "c")]
    assert sorted(map(tuple, T.toggle(df.withColumn("f", F.lit(True)), "f", F.col("k") == 1).select("k", "f").collect())) == [(1, False), (2, True), (3, True)]
    short = spark.createDataFrame([(9, "z"), (8, "y")], "a LONG, b STRING")
    assert sorted((r.v, r.b) for r in T.zip_rows(df, short, [F.col("k")], [F.col("a")]).collect()) == [("a", "y"), ("b", "z")]
    assert T.is_subset(edits.select("k"), df.select("k")).first()[0] is True


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 250), (2, ""), (3, None), (4, "y" * 10)], "k LONG, t STRING")
    got = [(r[0], r[1], len(r[2])) for r in X.fixed_chunks(df, "k", "t").orderBy("k", "chunk_index").collect()]
    assert got == [(1, 0, 100), (1, 1, 100), (1, 2, 90), (2, 0, 0), (3, 0, 0), (4, 0, 10)]
    with pytest.raises(ValueError):
        X.fixed_chunks(df, "k", "t", 10, 10)


def test_recursive_split_keeps_words_and_size():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(i * 3)) for i in range(1, 9)) + " " + "z" * 400
    chunks = X.split_recursively(text)
    assert all(0 < len(c) <= 150 for c in chunks)
    words = {w for c in chunks for w in c.split()}
    assert {w for w in text.split() if len(w) < 100} <= words
    assert X.split_recursively("") == [] and X.split_recursively("short") == ["short"]


def test_clean_html(spark):
    html = "<html><nav>menu</nav><!-- x --><h1>A &amp; B</h1><script>1<2</script><p>text\n here</p></html>"
    assert one(spark, X.clean_html(F.lit(html)), X.clean_html(F.lit(None).cast("string"))) == ("A & B text here", "")
    pages = spark.createDataFrame([(1, "intro<h1>One</h1><p>a</p><h2>Two</h2>b")], "p LONG, html STRING")
    assert [tuple(r) for r in X.sections(pages, "p", "html").collect()] == [(1, 0, "", "intro"), (1, 1, "One", "a"), (1, 2, "Two", "b")]


def test_context_holds_whole_hits(spark):
    from tablewright.operators import retrieve

    text = " ".join(f"word{i}" for i in range(200))
    hits = spark.createDataFrame([(1, 7, 1)], "query_id LONG, id LONG, rank LONG")
    got = retrieve.context(hits, spark.createDataFrame([(7, text)], "id LONG, text STRING")).collect()
    assert [tuple(r) for r in got] == [(1, f"[7] {text}")]
