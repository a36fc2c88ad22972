"""Truth tables of the column functions and the ordered operators against plain loops."""

import random

from pyspark.sql import functions as F

from recordweave.functions import hosts, html, text
from recordweave.operators import dedupe, state


def one(spark, values, f, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i int, a {kind}" + (f", b {kind}" if isinstance(values[0], tuple) else "")).select("i", f.alias("y")).orderBy("i").collect()]


def test_registrable_domain(spark):
    urls = ["https://www.acme.co.uk/contact", "shop.sensor.uk.com", "co.uk", "uk.com", "HTTP://User@Deep.Acme.example:80/x", "1.2.3.4", "a..b", None, "localhost"]
    assert one(spark, urls, hosts.registrable_domain(hosts.host(F.col("a")))) == ["acme.co.uk", "sensor.uk.com", "", "", "acme.example", "", "", "", ""]


def test_mailbox(spark):
    boxes = ["  Info@Acme.example ", "a@@b.example", "a.@b.example", "www.x@b.example", "é@b.example", "x@co.uk", "x@-b.example", None, "A.B+c@x.acme.co.uk"]
    assert one(spark, boxes, hosts.mailbox(F.col("a"))) == ["info@acme.example", "", "", "", "", "", "", "", "a.b+c@x.acme.co.uk"]


def test_attribution_is_directional(spark):
    pairs = [("acme.example", "acme.example"), ("acme.example", "mail.acme.example"), ("mail.acme.example", "acme.example"), ("a.acme.example", "b.acme.example"), ("co.uk", "co.uk")]
    assert one(spark, pairs, hosts.attributable(F.col("a"), F.col("b"))) == [True, True, False, False, False]


def test_pages(spark):
    page = '<html><head><title> A <b>x</b>\n </title><script>var t="</p>";</script></head><!-- no --><body>One&amp;two<br>three <a href="/c">c</a><a class="k" href="d?x=1">d</a>'
    assert one(spark, [page, "<h1>H</h1>", ""], html.title(F.col("a"), "?")) == ["A x", "H", "?"]
    assert one(spark, [page], html.visible_text(F.col("a"))) == ["A x One&two three c d"]
    assert one(spark, [page], html.links(F.col("a"))) == [["/c", "d?x=1"]]
    assert one(spark, [("/c", "http://h.example/a/b"), ("d", "http://h.example/a/b"), ("//k.example", "https://h.example/"), ("mailto:x", "http://h.example/")], html.resolve(F.col("a"), F.col("b"))) == ["http://h.example/c", "http://h.example/a/d", "https://k.example", "mailto:x"]


def test_text(spark):
    assert one(spark, [" A  b \n", None], text.name_key(F.col("a"))) == ["a b", ""]
    assert one(spark, ["motor-control unit", "xmotor control", "motors control"], text.phrase(F.col("a"), "motor control")) == [True, False, False]
    assert one(spark, ["my-shop_one.example"], text.title_case_label(F.col("a"))) == ["My Shop One"]


def test_greedy_equals_one_pass(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(60)]), rng.randrange(80), rng.choice([None, *range(40)])) for i in range(300)]
    seen, kept = set(), []
    for pos, *keys in rows:
        own = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not own & seen:
            seen |= own
            kept.append(pos)
    df = spark.createDataFrame(rows, "pos int, a int, b int, c int")
    assert sorted(r.pos for r in dedupe.greedy(df, "pos", ["a", "b", "c"]).collect()) == kept


def test_growth_and_circuit_equal_loops(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.random() < 0.25, rng.random() < 0.3) for k in range(8) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, i int, hit boolean, failed boolean")
    want, tried = {}, {}
    for k, _, hit, failed in rows:
        level, streak = want.get(k, (0, 0))
        streak = 0 if hit else streak + 1
        want[k] = (level + 1, 0) if streak == 3 else (level, streak)
        n, bad = tried.get(k, (0, 0))
        if bad < 2:
            tried[k] = (n + 1, bad + failed)
    got = {r.k: (r.level, r.streak) for r in state.growth(state.zero_runs(df, "k", ["i"], F.col("hit")), "k").collect()}
    assert got == want
    assert {r.k: r["count"] for r in state.circuit(df, "k", ["i"], F.col("failed")).groupBy("k").count().collect()} == {k: n for k, (n, _) in tried.items()}


def test_cadence(spark):
    df = spark.createDataFrame([(100, 150, True), (100, 100 + 19_800, True), (200, 100, True), (100, 150, False)], "due long, done long, ok boolean")
    assert [r.n for r in df.select(state.next_due(F.col("due"), F.col("done"), F.col("ok")).alias("n")).collect()] == [19_900, 100 + 2 * 19_800, 200, 19_950]
