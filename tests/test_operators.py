"""Operators against brute force, where SQL cannot say it or small tables would not show it."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import reliability as L
from tablewright.functions import containers as B
from tablewright.functions import strings as S
from tablewright.operators import predicates as P
from tablewright.operators import retrieve as V
from tablewright.operators import tables as R
from tablewright.operators import text as X
from tablewright.sources import readers, scratch, sinks


def test_places_of_many_rows_are_exact(spark):
    n = 120_000
    rows = spark.range(n).select("id", F.xxhash64("id").alias("h"), F.lit("user's").alias("at"), F.lit(7).alias("block"))
    got = R.numbered(rows, [F.col("h"), F.col("id")], "place", start=1)
    assert got.columns == ["id", "h", "at", "block", "place"]
    found = [(r.place, r.h) for r in got.collect()]
    found.sort()
    assert [p for p, _ in found] == list(range(1, n + 1))
    hashes = [h for _, h in found]
    assert hashes == sorted(hashes)
    down = {r.id: r.place for r in R.numbered(rows, [F.desc("h"), F.asc("id")], "place", start=0).collect()}
    order = sorted(range(n), key={r.id: -r.h for r in rows.select("id", "h").collect()}.get)
    assert all(down[i] == k for k, i in enumerate(order))


def test_zip_of_many_rows(spark):
    left, right = spark.range(70_000).select((F.col("id") * 2).alias("a")), spark.range(50_000).select((-F.col("id")).alias("b"))
    got = R.zip_rows(left, right, [F.col("a")], [F.desc("b")]).collect()
    assert len(got) == 50_000 and all(r.a == -2 * r.b for r in got)


def test_numbered_of_nothing(spark):
    assert R.numbered(spark.range(0), [F.col("id")], "n").collect() == []


TEXTS = ["", "a", "x" * 100, "x" * 101, "ä€\U0001f600" * 70, "line\nbreaks\n\n" * 40, "\n" * 130, None]


@pytest.mark.parametrize("size,overlap", [(100, 20), (10, 0), (10, 9), (7, 5), (1, 0), (300, 299)])
def test_fixed_chunks(spark, size, overlap):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k LONG, t STRING")
    got = sorted((r.k, r.chunk_index, r.chunk) for r in X.fixed_chunks(rows, "k", "t", size, overlap).collect())
    step, wanted = size - overlap, []
    for k, text in enumerate(TEXTS):
        text = text or ""
        n = max(1, -(-(len(text) - overlap) // step))
        wanted += [(k, i, text[i * step : i * step + size]) for i in range(n)]
    assert got == wanted


def test_fixed_chunks_of_a_long_text_take_linear_time(spark):
    import time

    def took(n):
        rows = spark.createDataFrame([(1, "äbc d" * n)], "k LONG, t STRING")
        began = time.perf_counter()
        assert X.fixed_chunks(rows, "k", "t").count() == -(-(5 * n - 20) // 80)
        X.fixed_chunks(rows, "k", "t").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(10_000)
    assert took(800_000) < 12


def sentences_of(text):
    return [x for x in re.sub(r"([.!?])[ \t\n\r]+", "\\1\x01", text or "").split("\x01") if x]


def alike_brute(parts, percentile):
    if len(parts) < 2:
        return parts
    bags = []
    for p in parts:
        bag = {}
        for w in re.findall("[a-z0-9]+", p.lower()):
            at = zlib.crc32(w.encode()) % 64
            bag[at] = bag.get(at, 0) + 1
        bags.append(bag)
    gaps = []
    for a, b in zip(bags, bags[1:]):
        dot = sum(n * b.get(k, 0) for k, n in a.items())
        size = sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5
        gaps.append(1 - dot / size if size else 1.0)
    ranked, at = sorted(gaps), percentile * (len(gaps) - 1)
    low = int(at)
    limit = ranked[low] + (at - low) * (ranked[min(low + 1, len(ranked) - 1)] - ranked[low])
    out = [[parts[0]]]
    for part, gap in zip(parts[1:], gaps):
        if gap > limit + 1e-12:
            out.append([])
        out[-1].append(part)
    return [" ".join(x) for x in out]


def test_semantic_chunks_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1, None), (1, ""), (1, "One. Two? !"), (2, "a b. a b. z z. a b."), (2, "...")], "doc_id LONG, text STRING")
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        wanted = sorted((d, i, c) for d, t in rows for i, c in enumerate(alike_brute(sentences_of(t), 0.9)))
        assert sorted((r.doc_id, r.chunk_index, r.chunk) for r in X.semantic_chunks(df, "doc_id", "text").collect()) == wanted


def test_recursive_chunks_hold_every_word_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {}
    for r in sorted(X.recursive_chunks(docs, "doc_id", "text").collect()):
        found.setdefault(r.doc_id, []).append(r.chunk)
    assert found
    for doc, text in texts.items():
        chunks = found.get(doc, [])
        assert all(0 < len(c) <= 150 and c == c.strip() for c in chunks)
        solid, ends = "".join(text.split()), {0}  # repeated words leave several places where a chunk can lie
        for c in chunks:
            c = "".join(c.split())
            starts = {at for end in ends for at in range(max(0, end - 40), end + 1)}  # an overlap of 20
            ends = {at + len(c) for at in starts if solid.startswith(c, at)}
            assert ends, (doc, c)  # nothing between two chunks is lost
        assert len(solid) in ends


def test_page_sections_keep_all_text(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = X.sections(pages, "page_id", "html").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.page_id, r.section)):
        by.setdefault(r.page_id, []).append(f"{r.title} {r.body}")
    heads = {r.page_id: len(re.findall("(?i)<h[1-6][ >]", r.html or "")) for r in pages.collect()}
    assert all(heads[p] <= len(parts) <= heads[p] + 1 for p, parts in by.items()) and set(by) == set(heads)


def test_dense_topk_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (100, 6)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 6), (500, None)], "id LONG, vector ARRAY<DOUBLE>").repartition(3)
    asked = rows.where("id % 10 = 0 AND id < 100").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in V.dense_topk(asked, rows, 4).collect()}
    norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)
    for q in range(0, 100, 10):
        scores = np.round(vectors @ vectors[q] / norms / norms[q], 6)
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]
    assert V.dense_topk(asked.limit(0), rows, 4).collect() == [] == V.dense_topk(asked, rows.limit(0), 4).collect()


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_containers(spark):
    items = F.array(*map(F.lit, ("a", "b", "a")))
    row = one(spark, B.inserted(items, 99, F.lit("z")), B.inserted(items, -1, F.lit("z")), B.inserted(items, -9, F.lit("z")), B.without_first(items, F.lit("a")),
              B.without_first(items, F.lit("q")), B.popped(items, 7)[0], B.popped(items, 7)[1], B.popped(items, 1)[1], B.discarded(items, F.lit("q")))
    assert [list(x) if x is not None else None for x in row] == [list("abaz"), list("abza"), list("zaba"), list("ba"), list("aba"), None, list("aba"), list("aa"), list("aba")]
    with pytest.raises(Exception, match="no such member: q"):
        one(spark, B.removed(items, F.lit("q")))
    left, right = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))
    assert one(spark, B.merged(left, right)).c0 == {"a": 1, "b": 3} and one(spark, B.merged(right, left)).c0 == {"b": 2, "a": 1}
    value, rest = B.popped_key(left, "a")
    assert tuple(one(spark, value, rest)) == (1, {"b": 2})


def test_formats(spark):
    row = one(spark, S.fixed(F.lit(1234567.891), 2), S.thousands(F.lit(1234567)), S.thousands(F.lit(-1234567.5), 2), S.fixed(F.lit(3), 1))
    assert list(row) == ["1234567.89", "1,234,567", "-1,234,567.50", "3.0"]
    for text, minutes in (("9:00", 540), ("12:30", 750), ("4:5", None), ("24:00", None), ("x", None), ("00:07", 7)):
        assert one(spark, S.minutes_of_day(F.lit(text))).c0 == minutes
    assert tuple(one(spark, *S.email_parts(F.lit("a@b@c.de")), *S.email_parts(F.lit("nobody")))) == ("a@b", "c.de", None, None)


def test_wrappers(spark):
    calls = []

    @L.timed
    @L.retried(3, ValueError)
    @L.counted
    def flaky(limit):
        """Doc."""
        calls.append(limit)
        if len(calls) < limit:
            raise ValueError("not yet")
        return len(calls)

    assert flaky(3) == 3 and flaky.__name__ == "flaky" and flaky.__doc__ == "Doc." and flaky.seconds >= 0
    with pytest.raises(ValueError, match="not yet"):
        flaky(99)
    assert flaky.__wrapped__.__wrapped__.calls == 6
    with pytest.raises(ValueError):
        L.retried(0)
    seen = []
    square = L.memoized(lambda x, y=0: seen.append(x) or x * x + y)
    assert [square(3), square(3), square(3, y=1), square(x=3)] == [9, 9, 10, 9] and len(seen) == 3
    last = L.memoized_last(1)(lambda x: seen.append(x) or x)
    last(1), last(2), last(1)
    assert len(seen) == 6
    tries = []
    assert L.repeated(3)(lambda: tries.append(0) or len(tries))() == 3 and L.repeated(0)(lambda: 1)() is None
    with pytest.raises(RuntimeError, match="reading prices: 'x'") as caught:
        L.with_context("reading prices", KeyError)(lambda: {}["x"])()
    assert isinstance(caught.value.__cause__, KeyError)
    safe = L.falling_back({LookupError: "lookup", KeyError: lambda e: f"key {e}"})
    assert safe(lambda: {}["x"])() == "key 'x'" and safe(lambda: [][1])() == "lookup" and safe(lambda: 3)() == 3
    with pytest.raises(ZeroDivisionError):
        safe(lambda: 1 / 0)()
    rows, watch = L.observed(spark.range(17).where("id > 3"), "seen")
    rows.collect()
    assert watch.get["n"] == 13


def test_stored_tables_can_be_discarded(spark):
    a, b = scratch.store(spark.range(5), "a"), scratch.store(spark.range(6), "b")
    own = spark.range(3)
    scratch.discard(a, own)
    assert b.count() == 6 and own.count() == 3
    with pytest.raises(Exception):
        a.count()


def test_versions_of_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    assert sinks.write_version(spark.range(3), path) == 0
    assert sinks.write_version(sinks.read_version(spark, path).where("id > 0"), path) == 1
    (tmp_path / "t" / "version-000002").mkdir()  # a write that has not ended
    assert sinks.read_version(spark, path).count() == 2 and sinks.read_version(spark, path, 0).count() == 3


def test_pretty_array_has_a_bound(spark):
    assert sinks.pretty_array(spark.range(3), "id", 3).first().value.count("id") == 3
    with pytest.raises(Exception, match="more than 3 rows"):
        sinks.pretty_array(spark.range(4), "id", 3).collect()


def test_random_texts_split_recursively():
    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice("ab \n") for _ in range(random.randint(0, 600)))
        chunks = X.split_recursively(text, 30, 5)
        assert all(len(c) <= 30 for c in chunks)
        assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_typed_records(spark):
    rows = spark.createDataFrame([("1", "x", True), ("2", None, False)], "a STRING, b STRING, c BOOLEAN")
    got = P.typed(rows, "b STRING, a INT NOT NULL, d DOUBLE, c STRING")
    assert [tuple(r) for r in got.collect()] == [("x", 1, None, "true"), (None, 2, None, "false")]
    with pytest.raises(Exception, match="b is not int: x"):
        P.typed(rows, "b INT").collect()
    assert [r.b for r in P.typed(rows, "b INT", strict=False).collect()] == [None, None]
    with pytest.raises(Exception, match="b is required"):
        P.typed(rows, "b STRING NOT NULL").collect()


def test_tables_stay_whole(spark):
    table = "Prices are:\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(60))
    text = "Intro. " * 30 + "\n" + table + "\n" + "Sentence one here. Another one! " * 40
    parts = X.fenced_parts(text, 200)
    assert sum("row 0 |" in p and "row 59 |" in p and "Prices are:" in p for p in parts) == 1
    assert all(len(p) <= 200 for p in parts if "|" not in p)
    assert "".join("".join(parts).split()) == "".join(text.split())
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k LONG, t STRING")
    assert [r.chunk for r in sorted(X.table_chunks(rows, "k", "t", 200).collect())] == parts


def test_setting_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# a comment\n\n  key=1  \n\t# more\nlast")
    assert sorted(r.value for r in readers.setting_lines(spark, f"file://{tmp_path}/s.txt").collect()) == ["key=1", "last"]
