"""Sources and sinks on small files."""

import zipfile

import pytest
from pyspark.sql import types as T

from tradewind.sources import files, generator, paged, sinks
from tradewind.sources.xlsx import XlsxSource

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Invoice</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>12345678901234567890</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>n/a</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")


def test_xlsx(spark, tmp_path):
    book(tmp_path / "b.xlsx")
    spark.dataSource.register(XlsxSource)
    rows = spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).load().orderBy("row_number").collect()
    assert [(r.sheet, r.row_number, [tuple(c) for c in r.cells]) for r in rows] == [
        ("One", 1, [("Invoice", "text"), (None, "blank"), ("Price", "text")]),
        ("One", 2, [("12345678901234567890", "numeric"), ("1", "boolean"), ("n/a", "text")]),
    ]


def test_csv_header(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.csv").write_text("﻿a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "x.csv"), schema).collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "y.csv").write_text("b,a\nx,1\n")
    with pytest.raises(ValueError):
        files.csv(spark, str(tmp_path / "y.csv"), schema)


def test_pages_retry():
    calls, waits = [], []

    def fetch(cursor):
        calls.append(cursor)
        if len(calls) == 1:
            raise paged.Retryable("slow down", 3.0)
        if len(calls) == 2:
            raise paged.Retryable("again")
        return {"rows": [{"id": len(calls)}], "next": "c2" if cursor is None else None}

    assert list(paged.pages(fetch, sleep=waits.append)) == [[{"id": 3}], [{"id": 4}]] and waits == [3.0, 1.0]


def test_extract(spark):
    def fetch(shard, cursor):
        return {"rows": [{"shard": shard, "day": f"2024-01-0{i}"} for i in (1, 2)], "next": None if cursor else "more"}

    assert paged.extract(spark, ["a", "b"], fetch, "shard string, day string", "day", "2024-01-02").count() == 4


def test_generator_is_stable(spark):
    a = generator.journeys(spark, 500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, generator.journeys(spark, 500).repartition(7).collect()))
    n = {r.event_type: r["count"] for r in a.groupBy("event_type").count().collect()}
    assert n["product_viewed"] == 500 and n["product_viewed"] > n["product_added_to_cart"] > n["checkout_started"]


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([("b1", 1, "x"), ("b2", 2, "y")], "business_id string, k int, v string")
    sinks.overwrite(df, f"{base}/gold/t", [f"{base}/gold"], ["business_id"])
    for bad in (f"{base}/gold", f"{base}/other/t", f"{base}/gold/../x"):
        with pytest.raises(ValueError):
            sinks.overwrite(df, bad, [f"{base}/gold"])
    sinks.replace_tenants(df.filter("business_id = 'b1'").selectExpr("business_id", "k + 10 as k", "v"), f"{base}/gold/t")
    assert sorted((r.business_id, r.k) for r in spark.read.parquet(f"{base}/gold/t").collect()) == [("b1", 11), ("b2", 2)]
    assert files.data_files(spark, f"{base}/gold/t").count() == 2
    sinks.upsert(df, f"{base}/u", ["k"])
    sinks.upsert(spark.createDataFrame([("b1", 1, "new"), ("b3", 3, "z")], df.schema), f"{base}/u", ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{base}/u").collect()) == [(1, "new"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError):
        sinks.swap(df.limit(0), f"{base}/u", lambda d: d.count() > 0)
    assert spark.read.parquet(f"{base}/u").count() == 3
