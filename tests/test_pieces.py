"""Splittable reads of quoted CSV and JSON arrays against whole-file parsing."""
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows, write
from tablework.sources import pieces
from tablework.sources.readers import read_files

CELLS = ["a", "", '"x"', '"a,b"', '"l1\nl2"', '"say ""hi"""', '5" pipe', '"\n\n"', '""', '"q"z', '"x\n""y"" ,\nz"', "é", '"é\nü"']


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def odd_csv(seed, n=200, cells=CELLS):
    r = random.Random(seed)
    out = ["id,one,two\n"]
    for i in range(n):
        out.append(f"{i},{r.choice(cells)},{r.choice(cells)}\n")
        if r.random() < 0.05:
            out.append("\n")
    return "".join(out)


def whole_file_rows(spark, path, schema):
    got = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    return rows(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_rows_as_whole_file_parsing(spark, tmp, small_splits, seed):
    paths = [write(tmp, f"{i}.csv", odd_csv(seed * 10 + i)) for i in range(2)]
    df, res = read_files(spark, str(tmp), "csv", lineage=False)
    assert rows(df) == whole_file_rows(spark, paths, "id string, one string, two string")
    assert pieces.text_pieces(spark, paths).select(F.spark_partition_id()).distinct().count() > 10


def test_record_over_many_splits(spark, tmp, small_splits):
    text = "\n".join(f"line {i}, with a comma" for i in range(300))
    p = write(tmp, "a.csv", f'id,text\n1,"{text}"\n2,x\n3,"{text}"\n')
    df, _ = read_files(spark, p, "csv", lineage=False)
    assert rows(df) == [("1", text), ("2", "x"), ("3", text)]


def test_file_that_ends_inside_quotes(spark, tmp, small_splits):
    p = write(tmp, "a.csv", 'id,text\n1,"a\nb"\n2,"open\nend')
    df, _ = read_files(spark, p, "csv", lineage=False)
    assert rows(df)[0] == ("1", "a\nb") and rows(df)[1][0] == "2"


@pytest.mark.parametrize("line_break,encoding", [("\r\n", "utf-8"), ("\r", "utf-8"), ("\n", "cp1252"), ("\n", "utf-8-sig")])
def test_line_breaks_and_encodings(spark, tmp, small_splits, line_break, encoding):
    text = odd_csv(5, 80).replace("\n", line_break)
    p = write(tmp, "a.csv", text.encode(encoding))
    df, _ = read_files(spark, p, "csv", lineage=False, multiline=True)
    plain = write(tmp / "plain", "a.csv", odd_csv(5, 80))
    assert rows(df) == whole_file_rows(spark, plain, "id string, one string, two string")


def test_bad_rows_of_split_records(spark, tmp, small_splits):
    body = "".join(f'{i},"x\ny",z\n' + f'{i},"p\nq"\n' + f'{i},"p\nq",r,s\n' for i in range(40))
    p = write(tmp, "a.csv", "a,b,c\n" + body)
    keep, _ = read_files(spark, p, "csv", lineage=False)
    assert keep.count() == 120 and keep.where("c is null").count() == 40
    drop, _ = read_files(spark, p, "csv", lineage=False, bad_rows="drop_malformed")
    assert rows(drop) == sorted((str(i), "x\ny", "z") for i in range(40))
    assert drop.select("a").count() == 40
    skip, res = read_files(spark, p, "csv", lineage=False, bad_rows="skip_long")
    assert skip.count() == 80 and res.rejected_rows.count() == 40


def test_no_header_and_lineage(spark, tmp, small_splits):
    write(tmp, "b c.csv", '"x\ny",2\n' * 50)
    df, _ = read_files(spark, str(tmp), "csv", header=False)
    assert rows(df) == [("x\ny", "2", "b c.csv")] * 50


def test_other_delimiters(spark, tmp, small_splits):
    write(tmp, "a.csv", "a;b\n" + '"x;\n""y""";"z,\n"\n' * 60)
    df, _ = read_files(spark, str(tmp), "csv", lineage=False, delimiter=";")
    assert rows(df) == [('x;\n"y"', "z,\n")] * 60


# ------------------------------------------------------------------------ JSON
def objects(seed, n=120):
    r = random.Random(seed)
    return [{"id": i, "s": r.choice(["x", "}{", '"}', "\\", 'a\\"}]', "[{", "é", "\n"]),
             "n": {"k": [{"z": i}, {"z": None}]} if i % 3 else {"k": []}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_in_many_splits(spark, tmp, small_splits, indent):
    want = objects(1)
    for name in ("a.json", "b.json"):
        write(tmp, name, json.dumps(want, indent=indent, ensure_ascii=bool(indent)))
    df, res = read_files(spark, str(tmp), "json")
    got = [(r.id, r.s, [k.z for k in r.n.k], r._source_file) for r in df.collect()]
    key = lambda x: (x[0], x[3])
    assert sorted(got, key=key) == sorted([(o["id"], o["s"], [k["z"] for k in o["n"]["k"]], f) for o in want for f in ("a.json", "b.json")], key=key)
    assert not res.rejected_files and res.rejected_rows is None
    assert pieces.text_pieces(spark, [str(tmp / "a.json")], "}").select(F.spark_partition_id()).distinct().count() > 5


def test_json_array_shapes(spark, tmp):
    write(tmp, "a.json", " [ ]\n")
    write(tmp, "b.json", '\n[\n{"a": 1}\n,\n{"a": 2}\n]\n')
    write(tmp, "c.json", '[{"a": {}}]')
    write(tmp, "d.json", '{"a": 5}')
    df, res = read_files(spark, str(tmp), "json")
    assert not res.rejected_files
    assert sorted(r._source_file for r in df.collect()) == ["b.json", "b.json", "c.json", "d.json"]


@pytest.mark.parametrize("bad", ['[{"a": 3}, {"a": 4', '[{"a": 3}, {"a": ]', '[{"a": 3} {"a"}]', '[{"a": 3}', '{"a": 3', '[3, 4]', '[{"a": 3}] x'])
def test_broken_json_is_skipped_and_reported(spark, tmp, bad):
    write(tmp, "good.json", '[{"a": 1}, {"a": 2}]')
    write(tmp, "bad.json", bad)
    df, res = read_files(spark, str(tmp), "json")
    assert df.columns == ["a", "_source_file"]
    assert rows(df) == [(1, "good.json"), (2, "good.json")]
    assert [(f["file_name"], f["status"]) for f in res.rejected_files] == [("bad.json", "unreadable")]
    assert res.rejected_rows.count() >= 1
    assert {r.file: r.status for r in res.report().collect()} == {"good.json": "ok", "bad.json": "unreadable"}


def test_broken_json_lines_keep_the_other_lines(spark, tmp):
    write(tmp, "a.jsonl", '{"a": 1}\n{"a": \n{"a": 2}\n')
    write(tmp, "b.jsonl", '{"a": 3}\n')
    df, res = read_files(spark, str(tmp), "json")
    assert rows(df) == [(1, "a.jsonl"), (2, "a.jsonl"), (3, "b.jsonl")]
    assert [r.record for r in res.rejected_rows.collect()] == ['{"a": ']
    assert [(f["file_name"], f["status"]) for f in res.rejected_files] == [("a.jsonl", "partly read")]


def test_only_broken_json(spark, tmp):
    write(tmp, "a.json", "{")
    with pytest.raises(ValueError, match="no JSON records"):
        read_files(spark, str(tmp), "json")
