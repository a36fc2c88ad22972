"""Arrow functions over batches of any size hold Python objects of few rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from recordweave.functions import evidence, markup, sites
from recordweave.functions.slices import ROWS, by_slices


def test_few_rows_at_a_time():
    sizes = []

    def made(part):
        sizes.append(len(part))
        return pa.array([x.as_py() + 1 for x in part])

    for n in (0, 1, ROWS, 10_001):
        assert by_slices(made, pa.array(range(n), pa.int64())).to_pylist() == list(range(1, n + 1))
    assert max(sizes) == ROWS


def test_pages_hosts_and_drafts_of_many_slices(spark):
    n = 3 * ROWS + 1
    d = spark.range(n).repartition(1).select("id", F.concat(F.lit("<title>T"), "id", F.lit("</title><a href='/x"), "id", F.lit("'>L</a> sensor controller")).alias("html"), F.concat(F.lit("https://h"), "id", F.lit(".example/")).alias("url"))
    told = evidence.draft(F.array(F.lit("industrial sensor, controller.")), F.array("html"), F.lit("Acme Software Company"))
    got = {r.id: r for r in d.select("id", markup.title("html").alias("t"), markup.anchors("html", "url").alias("a"), sites.of(F.col("url")).alias("s"), told.alias("d")).collect()}
    assert len(got) == n
    for i, r in got.items():
        assert (r.t, r.a[0].href, r.s[0].host, r.d.hardware, r.d.exclusions) == (f"T{i}", f"https://h{i}.example/x{i}", f"h{i}.example", True, ["software-only"])
