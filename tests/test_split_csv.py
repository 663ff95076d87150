"""Multi-line CSV files read from byte ranges, against the reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.sources import raw_csv, split_csv

_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    before = {c: spark.conf.get(c) for c in _SIZES}

    def use(n):
        spark.conf.set(_SIZES[0], str(n))
        spark.conf.set(_SIZES[1], "1")

    yield use
    for c, v in before.items():
        spark.conf.set(c, v)


def _cell(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return ""
    if kind == 1:
        return "plain é"
    body = "".join(rng.choice(['a', 'b', ',', '\n', '""', ' ', 'ü']) for _ in range(rng.randrange(1, 60 if kind == 5 else 8)))
    return f'"x{body}"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [16, 200, 1 << 20])
def test_records_equal_those_of_the_whole_file_reader(spark, tmp_path, small_splits, size, end):
    rng = random.Random(size)
    for name in "ab":
        rows = [f"{i},{_cell(rng)},{_cell(rng)},{i % 3}" for i in range(30)]
        (tmp_path / f"{name}.csv").write_bytes((end.join(["appid,name,notes,positive", *rows]) + (end if name == "a" else "")).encode())
    want = raw_csv.read_raw_csv(spark, str(tmp_path), drop=()).collect()
    small_splits(size)
    got = raw_csv.read_raw_csv(spark, str(tmp_path), drop=(), split_files=True)
    assert got.columns == ["appid", "name", "notes", "positive"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and len(want) == 60
    if size < 1000:
        assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 1


def test_one_record_over_many_ranges_and_ranges_in_one_text(spark, tmp_path, small_splits):
    long = "\n".join(["line"] * 500)
    (tmp_path / "t.csv").write_text(f'appid,name\n1,"{long}"\n2,b\n3,"{long}\n"\n')
    small_splits(256)
    rows = raw_csv.read_raw_csv(spark, str(tmp_path), split_files=True).orderBy("appid").collect()
    assert [(r[0], r[1]) for r in rows] == [(1, long), (2, "b"), (3, long + "\n")]
    parts = split_csv.csv_records(spark, str(tmp_path)).select(F.length("text")).collect()
    assert len(parts) == 3


def test_edge_files(spark, tmp_path):
    (tmp_path / "head.csv").write_text("appid,name\n")
    assert raw_csv.read_raw_csv(spark, str(tmp_path / "head.csv"), split_files=True).count() == 0
    (tmp_path / "gaps.csv").write_text("appid,name\n\n1,a\n\n2,b")
    assert raw_csv.read_raw_csv(spark, str(tmp_path / "gaps.csv"), split_files=True).count() == 2
    (tmp_path / "odd.csv").write_text('appid,name\n1,"a\n2,b\n')
    with pytest.raises(Exception, match="without its partner"):
        raw_csv.read_raw_csv(spark, str(tmp_path / "odd.csv"), split_files=True).collect()
