"""Paged files, listed files and appended text."""

import glob

from pyspark.sql import functions as F

from quarry.operators.splitting import append_text
from quarry.sources.paged_files import read_paged, write_paged
from quarry.sources.text_files import read_listed


def test_pages_come_back_in_order_from_many_files_and_splits(spark, tmp_path):
    rows = [("a", n, f"page {n}\nof a" + "x" * (n % 50)) for n in range(1, 401)]
    rows += [("b", 1, None), ("b", 2, "two\fparts"), ("b", 3, ""), ("b", 4, "last")]
    pages = spark.createDataFrame(rows, "doc string, page_no long, text string")
    write_paged(pages.repartition(7), f"{tmp_path}/p", file_pages=90)
    assert len(glob.glob(f"{tmp_path}/p/doc=a/*.txt")) == 5
    want = sorted((d, n, (t or "").replace("\f", " ")) for d, n, t in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("600b", before):                  # a file in many splits, or in one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_paged(spark, f"{tmp_path}/p")
            assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_listed_files_and_missing_ones(spark, tmp_path):
    (tmp_path / "in" / "x y").mkdir(parents=True)
    (tmp_path / "in" / "x y" / "one.txt").write_text("first\nfile")
    (tmp_path / "in" / "two.txt").write_text("")
    (tmp_path / "in" / "a+b%.txt").write_text("odd")
    rows = [("1", "x y/one.txt"), ("2", "two.txt"), ("3", "none.txt"), ("4", None),
            ("5", "x y/one.txt"), ("6", "a+b%.txt")]
    listed = spark.createDataFrame(rows, "name string, place string")
    got = read_listed(listed, f"{tmp_path}/in", "name", "place")
    assert sorted((r["doc_name"], r["text"]) for r in got.collect()) == [
        ("1", "first\nfile"), ("2", ""), ("3", ""), ("4", ""), ("5", "first\nfile"),
        ("6", "odd")]


def test_appends_keep_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/t"
    for rows in ([("a\nb",), ("",)], [("a",)]):
        append_text(spark.createDataFrame(rows, "value string"), path)
    lines = spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count("*"))
    assert {r[0]: r[1] for r in lines.collect()} == {"a": 2, "b": 1, "": 1}
