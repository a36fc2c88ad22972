"""Fill-in-middle against a loop over the tokens, and its SQL."""

import hashlib
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from recordweave.llm import fim, queries
from recordweave.llm.common import read


def plain(doc_id, text):
    """n, form, prefix, middle, output by the rules, a token at a time."""
    space, ends, at = " \t\n\v\f\r", [], 0
    while at < len(text):
        start = at
        while at < len(text) and text[at] in space:
            at += 1
        while at < len(text) and text[at] not in space:
            at += 1
        ends.append(at)
        assert at > start
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(ends)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = [0, *ends][low], [0, *ends][high]
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m) if h4 % 100 < 80 else (n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m)


def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "\n\t ", "a", " a", "a ", "x<P>y", "<M>", "a <S", "P> <", "日本語　テスト \x1c\x1d z  é", "<S<S ><P <M", "a\x0bb\x0cc\rd\n\n", "<", "a" * 100_000, "wörd " * 60_000, " " * 100_000]
    made = ["".join(rng.choice("ab<>PSM \t\né") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*((i, t) for i, t in enumerate(odd * 8)), *((i + 1000, t) for i, t in enumerate(made)), (None, "no id at all"), (5, "again one id"), (5, "again one id"), (-7, "less than none")]


def test_equals_a_loop_over_the_tokens(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("output", F.lit(1)).withColumn("n", F.lit("x")).withColumn("form", F.lit(None).cast("int"))
    made = fim.fill_in_middle(frame)
    got = made.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    want = sorted(((i, *plain(i, t or ""), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_other_rates_and_seeds(spark):
    frame = spark.createDataFrame(texts(), "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(frame, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(frame, fim_percent=100, spm_percent=0).collect()} == {"plain", "psm"}
    assert fim.fill_in_middle(frame, seed=1).exceptAll(fim.fill_in_middle(frame, seed=42)).count() > 0


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, folder):
    got = queries.op13_fill_in_middle(spark, folder)
    assert got.where("output_sha256 is null or restored_sha256 is null").isEmpty()
    assert oracle.difference(got, queries.ORACLE_SQL["op13_fill_in_middle"], oracle.connect(folder)) == ""


def test_restores_every_document(spark, sf):
    docs = read(spark, sf, "documents")
    back = fim.fill_in_middle(docs).select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text"))
    assert back.exceptAll(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).isEmpty()
