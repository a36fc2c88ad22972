"""Imported lists, written tables and keyed streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from recordweave.sources import seeds, tables
from recordweave.streaming import keyed

FILES = {
    "aliases": ("﻿Company  Name,E-Mail,Website,邮箱4,国家\nAcme,Info@Acme.example; sales@acme.example,http://www.acme.example/,,Germany\n\"Two, Ltd\",,x,\"jo@two.example\nbob@gmx.de\",\n", 4, {"acme.example": "Acme", "two.example": "Two, Ltd", "gmx.de": "Two, Ltd"}),
    "headerless": ("jo@one-two.example,x\n,no address\n", 1, {"one-two.example": "One Two"}),
    "empty": ("", 0, {}),
}


@pytest.mark.parametrize("name", FILES)
def test_csv_lists(spark, tmp_path, name):
    text, n, companies = FILES[name]
    path = tmp_path / f"{name}.csv"
    path.write_text(text, encoding="utf-8")
    got = seeds.mails(seeds.read_csv(spark, str(path))).select("email", "domain", "company", "website", "country").collect()
    assert len(got) == n and {r.domain: r.company for r in got} == companies
    assert name != "aliases" or {(r.website, r.country) for r in got if r.domain == "acme.example"} == {("http://www.acme.example", "Germany")}


def _workbook(path, sheets):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Company</t></si><si><r><t>Ac</t></r><r><t>me</t></r></si></sst>')
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    text = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
    named = ['<c r="A1" t="s"><v>0</v></c>' + text("C1", "Email"), '<c r="A2" t="s"><v>1</v></c>' + text("C2", "info@acme.example")]
    _workbook(tmp_path / "b.xlsx", [named, [text("A1", "nothing"), text("A2", "x@lost.example")], [text("B1", "jo@bare.example")], []])
    got = seeds.mails(seeds.read(spark, str(tmp_path / "b.xlsx"))).collect()
    assert {(r.email, r.company) for r in got} == {("info@acme.example", "Acme"), ("jo@bare.example", "Bare")}
    with pytest.raises(ValueError):
        seeds.read(spark, "x.xls")


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    a, b = spark.range(3), spark.range(5).withColumn("later", F.lit("x"))
    assert tables.replace(a, folder) == 1 and tables.read(spark, folder).count() == 3
    assert tables.replace(b, folder) == 2 and tables.read(spark, folder).columns == ["id", "later"] and tables.read(spark, folder, 1).count() == 3
    (tmp_path / "t" / "v=00000003").mkdir()  # a write that did not end
    assert tables.versions(spark, folder) == [1, 2] and tables.replace(a, folder, dry_run=True) == 1 and tables.versions(spark, folder) == [1, 2]
    assert tables.replace(a, folder) == 4


def test_replaces_itself(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.replace(spark.range(3), folder)
    tables.replace(tables.read(spark, folder).union(spark.range(1)), folder)
    assert tables.read(spark, folder).count() == 4


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2026-01-01 00:00:00", 0), (2, "a", "2026-01-01 00:01:00", 0), (3, "b", "2026-01-01 00:02:00", 4), (4, "a", "2026-01-01 00:03:00", 0), (5, "b", "2026-01-01 00:04:00", 0)]
    made = spark.createDataFrame(rows, "pos long, k string, at string, found long").withColumn("at", F.to_timestamp("at"))
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))

    def ran(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {r.k for r in ran(keyed.first_seen(stream(), ["k"], "at", "1 day"), "append", "seen")} == {"a", "b"}
    assert {(r.k, r.n, r.found) for r in ran(keyed.counters(stream(), ["k"], ["found"]), "complete", "counted")} == {("a", 3, 0), ("b", 2, 4)}
    assert {(r.k, r.level, r.streak) for r in ran(keyed.growth(stream(), "k", "pos", "found"), "update", "grown")} == {("a", 1, 0), ("b", 0, 1)}


def test_log_grows(spark, tmp_path):
    folder = str(tmp_path / "log")
    tables.append(spark.range(2), folder)
    tables.append(spark.range(3), folder)
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == [0, 0, 1, 1, 2]
