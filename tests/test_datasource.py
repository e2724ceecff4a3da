"""Workbooks by sheet, and works written all or none."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import cleaner
from quillspark.sources import sinks, texts

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(*rows):
    cell = lambda r, k, v: "" if v is None else f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    return f"<worksheet {NS}><sheetData>" + "".join(f"<row>{''.join(cell(r, k, v) for k, v in enumerate(row))}</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"


def workbook(path, *sheets):
    with zipfile.ZipFile(path, "w") as z:
        for k, s in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", s)


def test_sheets_are_partitions(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", sheet(("Word", "Mean"), ("dog", "4.5"), ("cat", None)), sheet(("Mean", "Word"), ("1.5", "idea")))
    workbook(tmp_path / "b.xlsx", *[sheet(("Word", "Mean"), (f"w{k}", str(k))) for k in range(11)])
    first = texts.read_spreadsheet(spark, str(tmp_path / "a.xlsx"))
    assert first.columns == ["Word", "Mean"] and sorted(map(tuple, first.collect()), key=str) == [("cat", None), ("dog", "4.5")]
    every = texts.read_spreadsheet(spark, f"file://{tmp_path}", "all")
    assert every.rdd.getNumPartitions() == 13 and every.count() == 14
    assert {r.word: r.score for r in texts.concreteness(every).collect()} == {"dog": 4.5, "idea": 1.5, **{f"w{k}": float(k) for k in range(11)}}
    with pytest.raises(Exception, match="none.xlsx"):
        texts.read_spreadsheet(spark, str(tmp_path / "none.xlsx")).count()
    workbook(tmp_path / "e.xlsx", sheet())
    with pytest.raises(Exception, match="no rows"):
        texts.read_spreadsheet(spark, str(tmp_path / "e.xlsx")).count()


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_all_works_or_none(spark, tmp_path):
    out = tmp_path / "out"
    works = spark.createDataFrame([(f"w{k}", f"text {k}") for k in range(30)], "work string, cleaned string").repartition(6)
    assert sinks.write_texts(works, str(out))["files"] == 30 and len(names(out)) == 30
    failing = works.withColumn("cleaned", F.when(F.col("work") == "w7", F.raise_error(F.lit("lost"))).otherwise(F.concat("cleaned", F.lit(" new"))))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            sinks.write_texts(failing, str(out), mode=mode)
        assert names(tmp_path) == ["out"] and {p.read_text() for p in out.iterdir()} == {f"text {k}\n" for k in range(30)}
    with pytest.raises(Exception, match="lost"):
        sinks.write_texts(failing, str(tmp_path / "fresh"))
    assert names(tmp_path) == ["out"]


def test_append_overwrite_and_archives(spark, tmp_path):
    out = tmp_path / "out"
    one = spark.createDataFrame([("a", "1"), ("b", None)], "work string, cleaned string")
    sinks.write_texts(one, str(out))
    sinks.write_texts(spark.createDataFrame([("b", "2"), ("c", "3")], "work string, cleaned string"), str(out), mode="append")
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a_cleaned.txt": "1\n", "b_cleaned.txt": "2\n", "c_cleaned.txt": "3\n"}
    sinks.write_texts(one.limit(1), str(out))
    assert names(out) == ["a_cleaned.txt"]
    totals = sinks.zip_texts(cleaner.clean(spark.createDataFrame([(k, "He sat there.  ") for k in range(20)], "work int, text string").repartition(3)), str(tmp_path / "z"))
    assert totals == {"files": 20, "n_in": 300, "n_out": 260, "reduction": pytest.approx(100 * 40 / 300)}
    found = {}
    for p in (tmp_path / "z").iterdir():
        with zipfile.ZipFile(p) as z:
            found |= {n: z.read(n).decode() for n in z.namelist()}
    assert found == {f"{k}_cleaned.txt": "He sat there." for k in range(20)}
    assert sinks.write_texts(one.limit(0), str(tmp_path / "none"))["files"] == 0


def test_names_that_cannot_be(spark, tmp_path):
    for rows in ([("a/b", "x")], [("same", "x"), ("same", "y")]):
        with pytest.raises(Exception, match="name"):
            sinks.write_texts(spark.createDataFrame(rows, "work string, cleaned string"), str(tmp_path / "bad"))
        assert names(tmp_path) == []
