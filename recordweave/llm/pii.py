"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans; labelers (format, gazetteer, context, boundary) vote on each or
abstain; expectation-maximisation over the table of vote patterns estimates how reliable
each labeler is and how likely each span is real; with those estimates as soft labels a
naive Bayes span classifier is trained, which decides on the proposed spans.  Spans of the
base definitions stay whatever it says.  The text is read twice, to count and to decide;
what is learned is a few hundred numbers.  No shuffle moves a text.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
LABELERS = ("format", "gazetteer", "context", "boundary")
# The base definitions.  Possessive quantifiers and the look-behinds change no match: they keep long runs linear and off the stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)){3}$"
# What is proposed beyond them.
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++"
SECRET = r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_=-]{8,}+"
SECRET_NAME = r"(?i)^[a-z_-]+[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Words before a span that speak for its kind, in the order of KINDS, and some that speak against any.
CUES = ("e-?mail|mail|contact|write to", "ip|host|server|address|login", "card|visa|mastercard|amex|credit|payment", "phone|tel|telephone|mobile|cell|call|fax|whatsapp", "key|token|secret|password|passwd|pwd|credential", "ssn|social|security", "iban|bank|account|konto|cuenta|compte")
AGAINST = "version|section|isbn|issn|figure|table|chapter|release|build"
#: Gazetteers: top-level domains and country calling codes.
DOMAINS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|nl|be|at|ch|uk|eu|us|ca|mx|br|jp|cn|in|ru|pl|se|no|dk|fi|pt|ie|au|nz"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
ROUNDS = 15


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an expression that a lambda uses is computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of the array the op of start and all values before it.

    In blocks of about the square root of the array's length, as appending copies what is
    there: n values take n ** 1.5 small steps, not n * n.
    """

    def scan(part: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def blocked(v: Column) -> Column:
        width = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1), width), lambda i: F.slice(v, i + 1, width))
        firsts = lambda parts: scan(F.transform(parts, lambda b: F.aggregate(b, start, lambda a, x: op(a, x))), start)
        return _let(blocks, lambda parts: F.flatten(F.zip_with(parts, firsts(parts), scan)))

    return _let(values, blocked)


_LOW = (1 << 32) - 1
_FOUND = "array<struct<start:int,end:int,hit:string,left:string,from:int,to:int>>"


def _find(text: Column, pattern: str, maybe: Column) -> Column:
    """All matches as array<struct<start, end, hit, left, from, to>>: start and end in code points, from and to in bytes; left: up to 24 characters before it and after the last match.

    The pieces between the matches and the matches, turn by turn, give the places.
    """
    none = F.array().cast(_FOUND)

    def both(c: Column) -> Column:
        """The length in bytes above, that in code points below: one sum adds up both."""
        return F.shiftleft(F.octet_length(c).cast("long"), 32) + F.char_length(c)

    def placed(gaps: Column, hits: Column) -> Column:
        starts = _before(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: both(g) + both(h)), F.lit(0).cast("long"), lambda a, x: a + x)

        def span(h: Column, gap: Column, at: Column) -> Column:
            first, last = at + both(gap), at + both(gap) + both(h)
            low, high = (lambda x: x.cast("int")), (lambda x: F.shiftright(x, 32).cast("int"))
            return F.struct(low(first.bitwiseAND(_LOW)).alias("start"), low(last.bitwiseAND(_LOW)).alias("end"), h.alias("hit"), F.right(gap, F.lit(24)).alias("left"), high(first).alias("from"), high(last).alias("to"))

        return _let(starts, lambda at: F.transform(hits, lambda h, i: span(h, gaps[i], at[i])))

    some = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(_let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))))
    return F.when(maybe, some).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0 or -1 (abstains)."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1)


def _votes(kind: int, hit: Column, left: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    # Only the expressions of the kind at hand are built.
    form = (
        lambda: hit.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}$"),
        lambda: ~hit.rlike(r"(?:^|\.)0[0-9]"),
        lambda: n.between(13, 16) & digits.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"),
        lambda: n.between(10, 15) & ~digits.rlike(r"^(.)\1*$"),
        lambda: (F.length(hit) >= 16) & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
        lambda: ~hit.rlike("^(?:000|666|9)"),
        lambda: F.length(F.replace(hit, F.lit(" "))).between(15, 34),
    )[kind]()
    known = (
        lambda: _vote(hit.rlike(rf"(?i)(?:\.|dot.? ?)(?:{DOMAINS})$")),
        lambda: _vote(~hit.rlike(r"^(?:0|127|255|22[4-9]|23[0-9])\.")),
        lambda: _vote(digits.rlike("^[3456]"), digits.rlike("^[0789]")),
        lambda: _vote(hit.startswith("+") & digits.rlike(f"^(?:{CALLING})"), hit.startswith("+")),
        lambda: _vote(hit.rlike("^(?:[0-9a-f]{32,}|[A-Z0-9]{20,}|[A-Za-z0-9+/_=-]{24,})$"), F.length(hit) < 12),
        lambda: F.lit(-1),
        lambda: _vote(hit.rlike(f"^(?:{COUNTRIES})")),
    )[kind]()
    context = _vote(left.rlike(rf"(?i)(?:^|[^a-z])(?:{CUES[kind]})[^a-z]*$"), left.rlike(rf"(?i)(?:^|[^a-z])(?:{AGAINST})[^a-z]*$"))
    boundary = _vote(~left.rlike(r"[\p{L}\p{N}]$"))
    return F.array(_vote(form), known, context, boundary)


def _features(kind: int, hit: Column, left: Column, votes: Column) -> Column:
    """What the span classifier sees, as words; for each kind there are under 40."""
    edge = F.when(left == "", "none").when(left.rlike(r"\s$"), "space").when(left.rlike(r"\p{L}$"), "letter").when(left.rlike(r"\p{N}$"), "digit").otherwise("sign")
    size = F.least(F.floor(F.length(hit) / 4), F.lit(9)).cast("string")
    marks = F.concat(*(F.when(hit.contains(x), x).otherwise("") for x in ("+", "(", "-", "@")))
    return F.array(*(F.concat(F.lit(f"{kind}:{name}:"), value) for name, value in (("edge", edge), ("size", size), ("marks", marks), *((l, votes[i].cast("string")) for i, l in enumerate(LABELERS[:3])))))


def _spans(text: Column) -> Column:
    """array<struct<start, kind, end, base, votes, features, from, to>> of all proposed spans, by start, then kind."""
    digit = text.rlike("[0-9]")

    def named(found: Column, kind: int, base: bool, keep: Callable[[Column], Column] | None = None) -> Column:
        found = F.filter(found, lambda x: keep(x["hit"])) if keep else found

        def one(x: Column) -> Column:
            votes = _votes(kind, x["hit"], x["left"])
            return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"), votes.alias("votes"), _features(kind, x["hit"], x["left"], votes).alias("features"), x["from"].alias("from"), x["to"].alias("to"))

        return F.transform(found, one)

    def value(x: Column) -> Column:
        """A secret's value, without the name and sign that lead to it, which count as its left."""
        lead = F.regexp_extract(x["hit"], SECRET_NAME, 0)
        return F.struct((x["start"] + F.char_length(lead)).alias("start"), x["end"].alias("end"), F.substr(x["hit"], F.char_length(lead) + 1).alias("hit"), F.right(lead, F.lit(24)).alias("left"), (x["from"] + F.octet_length(lead)).alias("from"), x["to"].alias("to"))

    base = F.concat(
        named(_find(text, EMAIL, text.contains("@")), 0, True),
        named(_find(text, IP, digit & text.contains(".")), 1, True, lambda h: h.rlike(OCTETS)),
        named(_find(text, CARD, digit), 2, True, _card),
        named(_find(text, PHONE, digit & text.contains("+")), 3, True, lambda h: F.length(_digits(h)).between(9, 15)),
    )
    more = F.concat(
        named(_find(text, SPELT_EMAIL, text.contains("(at)") | text.contains("[at]")), 0, False),
        named(_find(text, LOCAL_PHONE, digit), 3, False),
        named(F.transform(_find(text, SECRET, text.contains("=") | text.contains(":")), value), 4, False),
        named(_find(text, SSN, digit & text.contains("-")), 5, False),
        named(_find(text, IBAN, digit), 6, False),
    )
    return F.array_sort(F.concat(base, more))


def _card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def _free(spans: Column) -> Column:
    """The base spans and those of the others that no base span overlaps.

    By start, a span overlaps an earlier base span if the furthest end of those is past its
    start, and a later one if the nearest start of those is before its end.
    """
    far = F.lit(1 << 40)

    def apart(all_: Column) -> Column:
        ends = _before(F.transform(all_, lambda s: F.when(s["base"], s["end"]).otherwise(-1).cast("long")), F.lit(-1).cast("long"), F.greatest)
        starts = F.reverse(_before(F.transform(F.reverse(all_), lambda s: F.when(s["base"], s["start"]).otherwise(far)), far, F.least))
        return _let(ends, lambda e: _let(starts, lambda n: F.filter(all_, lambda s, i: s["base"] | ((e[i] <= s["start"]) & (n[i] >= s["end"])))))

    return _let(spans, lambda all_: F.when(F.exists(all_, lambda s: ~s["base"]) & F.exists(all_, lambda s: s["base"]), apart(all_)).otherwise(all_))


def _real(prior: Column, right: Column, wrong: Column, kind: Column, votes: Column) -> Column:
    """The probability that a span of that kind with those votes is real."""
    terms = F.transform(votes, lambda v, i: F.when(v == 1, F.ln(right[i] / wrong[i])).when(v == 0, F.ln((1 - right[i]) / (1 - wrong[i]))).otherwise(0.0))
    return 1 / (1 + F.exp(-(F.ln(prior[kind] / (1 - prior[kind])) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))))


def _reliabilities(patterns: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """By expectation-maximisation over patterns(kind, votes, n): each kind's share of real spans, and how often each labeler that votes says yes to a real and to another span.

    There are at most 3 ** labelers patterns a kind; they are one array in one row.
    """

    def total(post: Column, start: float, x: Callable[[Column], Column]) -> Column:
        return F.aggregate(post, F.lit(start), lambda a, p: a + x(p))

    def step(state: Column, _: Column) -> Column:
        def weighed(p: Column) -> Column:
            r = _real(state["prior"], state["right"], state["wrong"], p["kind"], p["votes"])
            return F.struct(p["kind"].alias("kind"), p["votes"].alias("votes"), (p["n"] * r).alias("t"), (p["n"] * (1 - r)).alias("f"))

        def counted(post: Column) -> Column:
            at = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
            # Each count starts from ten imagined votes, so a labeler that never votes keeps its first estimate.
            right = F.transform(at, lambda k: total(post, 8.0, lambda p: F.when(p["votes"][k] == 1, p["t"]).otherwise(0.0)) / total(post, 10.0, lambda p: F.when(p["votes"][k] >= 0, p["t"]).otherwise(0.0)))
            wrong = F.transform(at, lambda k: total(post, 2.0, lambda p: F.when(p["votes"][k] == 1, p["f"]).otherwise(0.0)) / total(post, 10.0, lambda p: F.when(p["votes"][k] >= 0, p["f"]).otherwise(0.0)))
            prior = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda j: total(post, 1.0, lambda p: F.when(p["kind"] == j, p["t"]).otherwise(0.0)) / total(post, 2.0, lambda p: F.when(p["kind"] == j, p["t"] + p["f"]).otherwise(0.0)))
            return F.struct(prior.alias("prior"), right.alias("right"), wrong.alias("wrong"))

        return F.transform(F.array(F.transform(F.col("patterns"), weighed)), counted)[0]

    first = F.struct(F.array_repeat(F.lit(0.5), len(KINDS)).alias("prior"), F.array_repeat(F.lit(0.8), len(LABELERS)).alias("right"), F.array_repeat(F.lit(0.2), len(LABELERS)).alias("wrong"))
    one = patterns.agg(F.collect_list(F.struct("kind", "votes", F.col("n").cast("double").alias("n"))).alias("patterns"))
    state = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step).alias("s")).first().s
    return state.prior, state.right, state.wrong


def proposed() -> Column:
    """The spans that count as proposed in the column text, without nulls; building so large an expression takes seconds, so it is done once a query."""
    return _free(_spans(F.col("text")))


def train(docs: DataFrame, spans: Column | None = None) -> dict:
    """What is learned from all spans proposed in docs(text): reliabilities, and the classifier's log odds of kinds and features.

    The only rows that reach the driver are one of reliabilities and one for each kind and feature.
    """
    spans = proposed() if spans is None else spans
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.explode(spans).alias("s")).select("s.kind", "s.votes", "s.features")
    seen = cut(found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    prior, right, wrong = _reliabilities(seen.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    real = _real(F.lit(prior), F.lit(right), F.lit(wrong), F.col("kind"), F.col("votes"))
    soft = seen.select("kind", "features", (F.col("n") * real).alias("t"), (F.col("n") * (1 - real)).alias("f"))
    sums = soft.select(F.explode(F.array_append("features", F.concat(F.col("kind").cast("string"), F.lit(":all")))).alias("feature"), "t", "f").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).collect()
    alls = {r.feature.split(":")[0]: (r.t, r.f) for r in sums if r.feature.endswith(":all")}
    odds = {}
    for r in sums:
        t, f = alls[r.feature.split(":")[0]]
        odds[r.feature] = log((t + 1) / (f + 1)) if r.feature.endswith(":all") else log((r.t + 1) / (t + 2)) - log((r.f + 1) / (f + 2))
    return {"prior": prior, "right": right, "wrong": wrong, "odds": odds}


def decided(spans: Column, model: dict) -> Column:
    """array<struct<start, kind, end, base, score, from, to>> of the proposed spans that count, by start, then kind; score is the classifier's probability."""
    odds = F.create_map(*(x for k, v in sorted(model["odds"].items()) for x in (F.lit(k), F.lit(v)))) if model["odds"] else F.create_map(F.lit(""), F.lit(0.0))

    def scored(s: Column) -> Column:
        known = F.transform(F.array_append(s["features"], F.concat(s["kind"].cast("string"), F.lit(":all"))), lambda f: F.coalesce(F.try_element_at(odds, f), F.lit(0.0)))
        score = 1 / (1 + F.exp(-F.aggregate(known, F.lit(0.0), lambda a, x: a + x)))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), score.alias("score"), s["from"].alias("from"), s["to"].alias("to"))

    return F.filter(F.transform(spans, scored), lambda s: s["base"] | (s["score"] >= 0.5))


def find_pii(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, spans (array<struct<start, kind, end, base, score, from, to>>; kind an index into KINDS), a row for each row of docs.

    start and end are code points, from and to bytes of UTF-8, both ends exclusive.  A null text counts as empty and has no
    spans; a null doc_id stays null; repeated rows give equal rows.  Without a model, one
    is trained on docs; an empty table trains the first estimates.  Columns other than
    doc_id and text are not read.
    """
    spans = proposed()
    model = model or train(docs, spans)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", decided(spans, model).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; spans that overlap become one, of the kind of the first.

    A null text stays null and an empty one empty; repeated rows give equal rows; all other
    columns stay, whatever their names; an empty table gives no rows.
    """
    spans = proposed()
    model = model or train(docs, spans)
    text = F.col("text")

    def clean(spans: Column, ends: Column) -> Column:
        """The texts before each span and the kinds, turn by turn, and the text after the last."""
        kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
        piece = lambda at, to: F.substring(text.cast("binary"), (at + 1).cast("int"), (to - at).cast("int")).cast("string")
        turns = F.transform(spans, lambda s, i: F.when(s["from"] >= ends[i], F.concat(piece(ends[i], s["from"]), kinds[s["kind"]])).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["to"]))
        return F.concat(F.array_join(turns, ""), piece(last, F.octet_length(text)))

    found = _let(decided(spans, model), lambda spans: F.when(F.size(spans) == 0, text).otherwise(_let(_before(F.transform(spans, lambda s: s["to"].cast("long")), F.lit(0).cast("long"), F.greatest), lambda ends: clean(spans, ends))))
    return docs.withColumn("text", F.when(text.isNotNull(), found))
