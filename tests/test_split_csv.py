"""Large CSV files cut into records by many tasks, against the one-task reader."""

import csv
import random

import pytest
from pyspark.sql import types as T

from dockline.sources import files, split_csv

NAMES = ["id", "note", "other"]
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in NAMES])


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def both(spark, path, schema=SCHEMA):
    return [sorted((tuple(r) for r in files._read_csv(spark, str(path), schema, split).collect()), key=str) for split in (False, True)]


def written(path, rows, end="\r\n", head=NAMES):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows([head, *rows])
    return path


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_reading_equals_the_one_task_reader(spark, tmp_path, tiny_splits, seed, end):
    pick = random.Random(seed)
    parts = ["a", "é", ",", '"', '""', "\n", "\n\n", "x" * 40, "\n," * 30, '5" pipe', " ", '"\n"']
    rows = [[str(i), "".join(pick.choices(parts, k=pick.randint(0, 6))), pick.choice(["", "end", "two\nlines"])] for i in range(120)]
    plain, split = both(spark, written(tmp_path / "t.csv", rows, end))
    assert split == plain and len(split) == 120
    assert split_csv._lines(spark, str(tmp_path / "t.csv")).select("at").distinct().count() > 20


def test_quotes_on_a_split_edge_and_records_longer_than_splits(spark, tmp_path, tiny_splits):
    for shift in range(0, 64, 6):  # many places of the quotes against the border
        rows = [["1", "p" * shift, "q\n,\"r\"\n" * 3], ["2", "line\n" * 60, "z"], ["3", "plain", "w"]]
        plain, split = both(spark, written(tmp_path / f"e{shift}.csv", rows))
        assert split == plain and len(split) == 3


def test_stray_quotes_open_no_value(spark, tmp_path, tiny_splits):
    path = tmp_path / "s.csv"
    path.write_text('id,note,other\n1,5" pipe,a\n2,say "hi",b\n' + '3,"x\n""y""\nz",c\n4,d,e"\n' * 20, newline="")
    plain, split = both(spark, path)
    assert split == plain and len(split) == 42


def test_header_over_several_splits_marks_and_empty_lines(spark, tmp_path, tiny_splits):
    head = ["id", "note", "a long header\n" * 20 + "other"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "note")])
    rows = [[str(i), f"n{i}\nm", "o"] for i in range(9)]
    plain, split = both(spark, written(tmp_path / "h.csv", rows, head=head), schema)
    assert split == plain and len(split) == 9
    path = tmp_path / "b.csv"
    path.write_bytes(("﻿id,note,other\r\n\r\n" + "".join(f'{i},"a\r\nb",\r\n\r\n' for i in range(40))).encode())
    plain, split = both(spark, path)
    assert split == plain and split[0] == ("0", "a\nb", None) and len(split) == 40
    path.write_bytes(b"\n" * 200 + b"id,note,other\n1,2,3\n")
    assert both(spark, path)[1] == [("1", "2", "3")]


def test_folders_short_records_and_files_without_rows(spark, tmp_path, tiny_splits):
    for k in range(3):
        written(tmp_path / f"f{k}.csv", [[f"{k}-{i}", "a\nb" * (i % 5), "c"] for i in range(20 * k)])
    plain, split = both(spark, tmp_path)
    assert split == plain and len(split) == 60
    path = tmp_path / "short.csv"
    path.write_text("other,id,note\n1\n1,2\n1,2,3,4\n" + ',"",""\n' * 30)
    plain, split = both(spark, path)
    assert split == plain and len(split) == 33
    with pytest.raises(ValueError, match="no column 'id'"):
        files._read_csv(spark, str(written(tmp_path / "n.csv", [], head=["x"])), SCHEMA, True)


def test_size_decides_who_reads(spark, tmp_path, monkeypatch, tiny_splits):
    used = []
    monkeypatch.setattr(files, "read_records", lambda *a: used.append(a) or split_csv.read_records(*a))
    small, large = written(tmp_path / "s.csv", [["1", "2", "3"]]), written(tmp_path / "l.csv", [["1", "2", "3"]] * 200)
    assert files._read_csv(spark, str(small), SCHEMA).count() == 1 and not used
    assert files._read_csv(spark, str(large), SCHEMA).count() == 200 and used


def test_an_unclosed_quote_takes_the_rest_of_its_file(spark, tmp_path, tiny_splits):
    path = tmp_path / "u.csv"
    path.write_text("id,note,other\n1,a,b\n2,\"open " + "x\n" * 200)
    found = [r.record for r in split_csv.records(spark, str(path)).collect()]
    assert sorted(len(r) for r in found) == [5, len("2,\"open ") + 399]
