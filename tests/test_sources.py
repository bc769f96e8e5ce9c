import pytest

from tablewright.sources import readers as R
from tablewright.sources import sinks as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_text_readers(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text(" one \ntwo\n\nthree")
    assert rows(R.whole_text(spark, str(p))) == [(" one \ntwo\n\nthree",)]
    assert rows(R.text_lines(spark, str(p))) == [("one",), ("two",), ("",), ("three",)]
    assert rows(R.numbered_lines(spark, str(p))) == [(0, " one "), (1, "two"), (2, ""), (3, "three")]


def test_csv_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("isbn, title , quantity, price\n 1 , A ,2, 3.5\n2,B,x,4\n")
    got = rows(R.csv_records(spark, str(p), "isbn STRING, title STRING, quantity BIGINT, price DOUBLE"))
    assert got == [("1", "A", 2, 3.5), ("2", "B", None, 4.0)]
    with pytest.raises(Exception):
        R.csv_records(spark, str(p), "isbn STRING, title STRING, quantity BIGINT, price DOUBLE", strict=True).collect()
    assert R.csv_records(spark, str(p), "a STRING, b STRING, c STRING, d STRING", header=False).count() == 3


def test_receipt_keeps_rejects(spark, tmp_path):
    p = tmp_path / "receipt.txt"
    p.write_text("tea, 1.5\nbroken\nbun, x\nrice, 20\n")
    good, bad = R.csv_with_rejects(spark, str(p), "name STRING, price DOUBLE")
    assert sorted(rows(good)) == [("rice", 20.0), ("tea", 1.5)]
    assert sorted(r[0] for r in rows(bad)) == ["broken", "bun, x"]


def test_json_readers(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"k": 1, "m": "x"}, {"k": 2}]')
    assert rows(R.json_records(spark, str(p), "k BIGINT, m STRING")) == [(1, "x"), (2, None)]
    assert rows(R.json_records(spark, str(tmp_path / "none.json"), "k BIGINT")) == []
    (tmp_path / "bad.json").write_text("{oops")
    assert rows(R.json_records(spark, str(tmp_path / "bad.json"), "k BIGINT")) == []
    p.write_text('{"T1": {"amount": 5.0, "type": "a"}, "T2": {"amount": 7.5}}')
    assert sorted(rows(R.json_keyed(spark, str(p), "amount DOUBLE, type STRING"))) == [("T1", 5.0, "a"), ("T2", 7.5, None)]


@pytest.mark.parametrize("version", [1, 2])
def test_store_round_trip(spark, tmp_path, version):
    data = [("A|b", "c", 'line\nand "quote"', ["x", "y"], True), ("B", "d", "p", [], False)]
    df = spark.createDataFrame(data, R.STORE_SCHEMA)
    S.write_store(df, str(tmp_path / "s"), version)
    assert sorted(rows(R.prompt_store(spark, str(tmp_path / "s"), version))) == data


def test_store_reads_loose_files(spark, tmp_path):
    p = tmp_path / "v1.txt"
    p.write_text("T|C|P| a, ,b |YES\n")
    assert rows(R.prompt_store(spark, str(p), 1)) == [("T", "C", "P", ["a", "b"], True)]
    assert rows(R.prompt_store(spark, str(tmp_path / "none"), 1)) == []


def test_delimited_lines(spark):
    df = spark.createDataFrame([("Acme, Pro, 12, yes",), ("B,Free,x,no",), ("C",)], "line STRING")
    got = rows(R.delimited_lines(df, "line", "name STRING, plan STRING, mrr BIGINT, active BOOLEAN"))
    assert got == [("Acme", "Pro", 12, True), ("B", "Free", None, False), ("C", None, None, None)]
    assert rows(R.number_range(spark, 2, 4)) == [(2,), (3,)]


def test_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(2, "b"), (1, None)], "k LONG, v STRING")
    path = str(tmp_path / "t")
    S.write_lines(df, path, "k")
    S.write_lines(df, path, "k", append=True)
    assert sorted(r[0] for r in rows(R.text_lines(spark, path))) == ["1", "1", "2", "2"]
    text = S.pretty_array(df, "k").first()[0]
    assert text.startswith("[") and text.index('"k" : 1') < text.index('"k" : 2') and "null" in text
    block = df.orderBy("k").select(S.labelled_block({"K": F.col("k"), "V": F.col("v")}).alias("b")).first()[0]
    assert block == "K: 1\nV: \n" + "-" * 20
    new = spark.createDataFrame([(2, "z"), (3, "n")], "k LONG, v STRING")
    assert sorted(rows(S.upsert(df, new, "k")), key=lambda r: r[0]) == [(1, None), (2, "z"), (3, "n")]
    S.write_json_lines(df, str(tmp_path / "j"))
    assert R.json_records(spark, str(tmp_path / "j"), "k LONG, v STRING").count() == 2
