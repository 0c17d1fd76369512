"""Records of logs that are cut into byte ranges."""

import csv
import io
import random

import pytest

from gaugeline.sources import logs, records


def told(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        found = records.records(spark, [f"file:{path}"])
        blocks = found.count() and spark.read.text(f"file:{path}").select("_metadata.file_block_start").distinct().count()
        return blocks, sorted((r["record"], r["text"]) for r in found.collect())
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")


def log(rng, n):
    """Rows with plain and quoted fields, some of which hold line ends and doubled quotes; blank lines in between."""
    rows, text = [], []
    for k in range(n):
        row = [str(k), rng.choice(["x", "", "a,b", 'say "so"', "one\ntwo", 'p\n\n"q"\nr,', "é漢"])]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(row)
        text.append(out.getvalue())
        rows.append(out.getvalue()[:-1])
        if rng.random() < 0.1:
            text.append(rng.choice(["\n", "  \n"]))
    return "".join(text), rows


@pytest.mark.parametrize("cuts", [1, 3, 50])
def test_records_are_those_of_the_whole_file(spark, tmp_path, cuts):
    text, rows = log(random.Random(cuts), 400)
    (tmp_path / "a.csv").write_text(text)
    blocks, got = told(spark, tmp_path / "a.csv", -(-len(text.encode()) // cuts))
    assert blocks >= min(cuts, 40)
    assert got == list(enumerate(rows))


@pytest.mark.parametrize("size", [7, 1000])
def test_line_ends_marks_and_stray_quotes(spark, tmp_path, size):
    (tmp_path / "a.csv").write_bytes("﻿h,i\r\n\r\n1,2\r\n\"3\r\n4\",5\r\n".encode())
    assert told(spark, tmp_path / "a.csv", size)[1] == [(0, "h,i"), (1, "1,2"), (2, '"3\n4",5')]
    (tmp_path / "b.csv").write_text('h\n"open\n\n1\n2"3"\n')
    assert told(spark, tmp_path / "b.csv", size)[1] == [(0, "h"), (1, '"open'), (2, "1"), (3, '2"3"')]
    (tmp_path / "c.csv").write_text("")
    assert told(spark, tmp_path / "c.csv", size)[1] == []


def test_quoted_line_ends_reach_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,"no\nte",x\n1,"a\nb ""c""",\\\n\n2,,"3"\n')
    files = spark.createDataFrame([(f"file://{tmp_path}/a.csv", "t"), (f"file://{tmp_path}/a.csv", "u")], "file_path string, trial_id string")
    got = [tuple(r) for r in logs.read_stream(spark, files).select("trial_id", "source_row_index", "time", "no\nte", "x").orderBy("trial_id", "source_row_index").collect()]
    assert got == [(t, *row) for t in "tu" for row in ((0, "1", 'a\nb "c"', "\\"), (1, "2", None, "3"))]


def test_an_optional_table_is_empty_only_if_missing_or_of_another_format(spark, tmp_path):
    assert logs.optional(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "broken.parquet").write_text("no parquet at all")
    assert logs.optional(spark, f"{tmp_path}/broken.parquet", "a int").count() == 0
    with pytest.raises(Exception, match="nosuch"):
        logs.optional(spark, str(tmp_path), "a int", fmt="nosuch")
