"""Every catalogue query against its SQL, on the smallest tables and on the next larger ones."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tablewright.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.fixture(scope="module")
def larger(small):
    return small.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def larger_duck(larger):
    return connect(larger)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    holds(spark, duck, small, name)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql_on_larger_tables(spark, larger_duck, larger, name):
    holds(spark, larger_duck, larger, name)


def holds(spark, duck, small, name):
    result = QUERIES[name](spark, small)
    rows = result.collect()
    columns = sorted(result.columns)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    wanted = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == wanted


def test_entry_has_the_catalogue(spark, small):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy without the corpus operators, the pipeline and their tests still imports and knows the catalogue."""
    gone = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(x.startswith('op1_') for x in e.queries()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False", "False"], said.stderr
    assert not any("tablewright.llm" in open(os.path.join(d, f)).read() for d, _, fs in os.walk(tmp_path / "copy" / "tablewright") for f in fs if f.endswith(".py"))


def test_every_document_has_chunk_records(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = QUERIES["all_chunk_records"](spark, small)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert "chunk" in got.columns


def test_bm25_counts_repeated_and_missing_ids_as_its_sql_does_and_sends_k_rows_a_task(spark, tmp_path, monkeypatch):
    from tablewright.operators import retrieve

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: ". ".join(" ".join(words[(i * j + j * j + n) % 10] for n in range(1 + (i + j) % 7)) for j in range(1 + i % 5))
    rows = [(i, text(i)) for i in range(400)] + [(None, text(i)) for i in (3, 8, 11)] + [(900, None), (901, "")]
    asked = [(i, " ".join(words[i % 3 : 3 + i % 4])) for i in range(12)]
    again = [(i, text(7 * i + 1)) for i in (5, 6, 6, 7)]
    seen = []
    top = retrieve._top
    monkeypatch.setattr(retrieve, "_top", lambda found, k, by: seen.append(found.count()) or top(found, k, by))
    for folder, more, names in ((tmp_path / "a", [], ("bm25_topk", "chunk_context")), (tmp_path / "b", again, ("bm25_topk",))):
        spark.createDataFrame(rows + more, "doc_id LONG, text STRING").repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(asked, "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
        with duckdb.connect() as db:
            for table in ("documents", "benchmark"):
                db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
            for name in names:
                got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
                assert sorted(got) == sorted(db.sql(ORACLE_SQL[name]).fetchall()), name
    assert max(seen) <= 5 * 12 * 8  # not each of 400 documents for each query
