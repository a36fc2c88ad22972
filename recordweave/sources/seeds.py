"""Lists of companies and mailboxes as CSV files or workbooks, whatever their headers are called."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.functions import fixed, hosts

ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def fields(header: list[str | None]) -> dict[str, list[int]]:
    """The columns of each known field, by the header's names; empty without a mail column."""
    out: dict[str, list[int]] = {}
    for at, name in enumerate(re.sub(r"\s+", " ", (h or "").strip().lower()) for h in header):
        if name in fixed.MAIL_HEADERS or name.startswith(fixed.MAIL_HEADER_STARTS):
            out.setdefault("email", []).append(at)
        else:
            field = next((f for f, names in fixed.HEADERS.items() if name in names), None)
            if field:
                out.setdefault(field, []).append(at)
    return out if "email" in out else {}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One file's rows: each known field (the first of its columns that isn't blank; else empty) and email, an array of the mail cells.

    A file whose first row names no mail column has no header: that row is data and every
    cell may hold mailboxes.  Only the first line comes to the driver; a mark at the
    file's start is dropped; an empty file gives no rows.
    """
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"', encoding="UTF-8")
    first = raw.limit(1).collect()
    names = raw.columns
    head = [(x or "").lstrip("\ufeff") for x in first[0]] if first else []
    known = fields(head)
    if known:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True, schema=", ".join(f"`{n}` string" for n in names))
    blank = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    cells = [names[i] for i in known.get("email", range(len(names)))]
    one = [F.coalesce(*(blank(names[i]) for i in known.get(f, [])), F.lit("")).alias(f) for f in fixed.HEADERS]
    return raw.select(*one, F.array(*(F.coalesce(F.col(n), F.lit("")) for n in cells)).cast("array<string>").alias("email"))


_MAIN, _REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheets(content: bytes) -> Iterator[Iterator[list[str]]]:
    """Each sheet of a workbook, in its order, as rows of cell texts; cells are read one row at a time."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def cells(row: ElementTree.Element) -> list[str]:
        out: list[str] = []
        for c in row.iter(f"{_MAIN}c"):
            at = 0
            for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            out += [""] * (at - 1 - len(out))
            v = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if v is None else v.text or ""
            out.append(shared[int(text)] if c.get("t") == "s" else text)
        return out

    def rows(name: str) -> Iterator[list[str]]:
        with book.open(name) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}row":
                    yield cells(e)
                    e.clear()

    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        name = target[sheet.get(f"{_REL}id")].lstrip("/")
        yield rows(name if name.startswith("xl/") else f"xl/{name}")


def _of_sheet(rows: Iterator[list[str]]) -> Iterator[dict]:
    """A sheet's rows as fields: by its header; all cells where the first row holds a mailbox instead; none otherwise."""
    first = next(rows, [])
    known = fields(first)
    if not known and not any(re.search(ADDRESS, c) for c in first):
        return
    blank = dict.fromkeys(fixed.HEADERS, "")
    if not known:
        yield blank | {"email": first}
    for r in rows:
        pick = lambda f: next((r[i].strip() for i in known.get(f, []) if i < len(r) and r[i].strip()), "")  # noqa: B023, E731
        yield blank | {f: pick(f) for f in fixed.HEADERS} | {"email": [r[i] for i in known["email"] if i < len(r)] if known else r}


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every sheet of the workbooks at path, as of read_csv; sheets without a mail column or mailbox in the first row have none.

    A workbook is read in one task: the format bounds a sheet to 1,048,576 rows.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(f, pa.string()) for f in fixed.HEADERS] + [("email", pa.list_(pa.string()))])
        for b in batches:
            for content in b.column("content"):
                held = []
                for sheet in _sheets(content.as_py()):
                    for row in _of_sheet(sheet):
                        held.append(row)
                        if len(held) == 1_000:
                            yield pa.RecordBatch.from_pylist(held, kind)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    schema = ", ".join(f"{f} string" for f in fixed.HEADERS) + ", email array<string>"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The list at path, by its ending; the old .xls format needs a reader that isn't here."""
    end = path.rpartition(".")[2].lower()
    if end == "xls":
        raise ValueError(f"{path}: .xls is not read; save it as .xlsx or .csv")
    return read_csv(spark, path) if end == "csv" else read_xlsx(spark, path)


def _domain_key(url: Column) -> Column:
    host = hosts.host(url)
    return F.coalesce(F.nullif(hosts.registrable_domain(host), F.lit("")), host)


def mails(rows: DataFrame) -> DataFrame:
    """rows(company_name, website, domain, email), a row for each valid mailbox of the email cells, with email, domain, company and website.

    The domain is the mailbox's; the website is the given one if it is of that domain, else
    the domain's own; a missing name is made of the domain's first label.
    """
    found = F.filter(F.flatten(F.transform("email", lambda c: F.transform(F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(0)), lambda m: hosts.mailbox(m)))), lambda m: m != "")
    out = rows.withColumn("email", F.explode(found)).withColumn("domain", _domain_key(hosts.mailbox_domain(F.col("email"))))
    label = F.initcap(F.trim(F.translate(F.split_part("domain", F.lit("."), F.lit(1)), "-_", "  ")))
    site = F.rtrim("website", F.lit("/"))
    site = F.when(_domain_key(site) == F.col("domain"), F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("https://"), F.ltrim(site, F.lit("/"))))).otherwise(F.concat(F.lit("https://"), F.col("domain")))
    return out.withColumn("company", F.coalesce(F.nullif("company_name", F.lit("")), label)).withColumn("website", site)
