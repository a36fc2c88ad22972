"""The query catalogue: each entry is a Spark query and, where SQL can say it, the DuckDB text for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordweave.functions import hosts, html, text
from recordweave.operators import dedupe, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def unescaped(x: str) -> str:
    """The entities that the tables have."""
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{sign}', 'g')"
    return x


def visible_sql(x: str) -> str:
    tagless = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|noscript|svg)[^>]*>.*?</(?:script|style|noscript|svg)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({unescaped(tagless)}, '\s+', ' ', 'g'))"


_CLEAN = rf"trim(regexp_replace({unescaped("regexp_replace({}, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g'))"


@query(rf"""select page_id, coalesce(nullif({_CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''),
    nullif({_CLEAN.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), 'unknown') as title from pages""")
def page_title(spark, sf_dir):
    """Title, else first heading, else a sentinel."""
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html"), "unknown").alias("title"))


@query(r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href from pages),
    r as (select page_id, case when regexp_matches(href, '^[a-z]+:') then href when starts_with(href, '//') then regexp_extract(url, '^([a-z]+:)', 1) || href
        when starts_with(href, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href else regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || href end as link from l)
    select page_id, count(*) as n_links, count(distinct link) as n_targets, min(link) as first_target from r group by page_id""")
def page_links(spark, sf_dir):
    """Anchors of each page, double-quoted href alone, resolved against its URL; a count, without classes or a form URL."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(html.links(F.col("html"))).alias("href"))
    return found.select("page_id", html.resolve(F.col("href"), F.col("url")).alias("link")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("link").alias("n_targets"), F.min("link").alias("first_target"))


@query(f"""with t as (select page_id, {visible_sql("html")} as visible from pages)
    select page_id, length(visible) as n_chars, case when visible = '' then 0 else len(string_split(visible, ' ')) end as n_words from t""")
def visible_text_stats(spark, sf_dir):
    """Length and words of each page's visible text."""
    t = table(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("visible"))
    return t.select("page_id", _long(F.char_length("visible")).alias("n_chars"), _long(F.when(F.col("visible") == "", 0).otherwise(F.size(F.split("visible", " ")))).alias("n_words"))


_HOST_SQL = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^www\.', '')"
_DOMAIN_SQL = f"array_to_string(list_slice(string_split({_HOST_SQL}, '.'), -2, -1), '.')"


@query(f"select page_id, {_HOST_SQL} as host from pages")
def host_norm(spark, sf_dir):
    """Normalised host of each page."""
    return table(spark, sf_dir, "pages").select("page_id", hosts.host(F.col("url")).alias("host"))


@query(f"select {_DOMAIN_SQL} as domain, count(*) as pages, count(distinct {_HOST_SQL}) as hosts from pages group by 1")
def reg_domain_counts(spark, sf_dir):
    """Pages and hosts by registrable domain."""
    h = table(spark, sf_dir, "pages").select(hosts.host(F.col("url")).alias("host"))
    return h.withColumn("domain", hosts.registrable_domain(F.col("host"))).groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))


@query(f"select page_id, domain from (select page_id, {_DOMAIN_SQL} as domain from pages) qualify row_number() over (partition by domain order by page_id) <= 5")
def page_quota_per_domain(spark, sf_dir):
    """At most five pages of each registrable domain, in order."""
    p = table(spark, sf_dir, "pages").select("page_id", hosts.registrable_domain(hosts.host(F.col("url"))).alias("domain"))
    return dedupe.within_quota(p, ["domain"], ["page_id"], 5)


@query("""with f as (select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1)
    select event_id, user_id, event_type from f qualify row_number() over (partition by event_type order by event_id) <= 50""")
def source_quota(spark, sf_dir):
    """First row of each key, then a quota for each source; a refused key stays seen."""
    return dedupe.first_then_quota(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", ["event_id"], 50)


@query(r"""with u as (select page_id, 0 as prio, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as page_key from pages
      union all select page_id + 1000000, 1, regexp_replace(regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', ''), '/+$', '') from pages)
    select page_id, page_key from u qualify row_number() over (partition by page_key order by prio, page_id) = 1""")
def url_union_dedupe(spark, sf_dir):
    """First occurrence of each page over two providers."""
    p = table(spark, sf_dir, "pages")
    a = p.select("page_id", F.lit(0).alias("prio"), hosts.page_key(F.col("url")).alias("page_key"))
    b = p.select((F.col("page_id") + 1_000_000).alias("page_id"), F.lit(1).alias("prio"), hosts.page_key(F.regexp_replace("url", r"\?.*$", "")).alias("page_key"))
    return dedupe.first_by(a.unionByName(b), ["page_key"], ["prio", "page_id"]).select("page_id", "page_key")


@query("select min(c_custkey) as c_custkey, lower(trim(c_mktsegment)) || '|' || c_nationkey as dedupe_key from customer group by 2")
def dedupe_key_exact(spark, sf_dir):
    """First customer of each name-and-country key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", text.company_country_key(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("dedupe_key"))
    return dedupe.first_by(c, ["dedupe_key"], ["c_custkey"])


@query("""with recursive c as (select c_custkey as pos, 'a' || (c_custkey * 31 % 701) as ka, 'b' || (c_custkey * 17 % 509) as kb from customer),
    r as (select row_number() over (order by pos) as i, * from c),
    g as (select 0::bigint as i, 0::bigint as pos, []::varchar[] as seen, false as kept
      union all select r.i, r.pos, case when list_has_any(g.seen, [r.ka, r.kb]) then g.seen else list_concat(g.seen, [r.ka, r.kb]) end, not list_has_any(g.seen, [r.ka, r.kb])
      from g join r on r.i = g.i + 1)
    select pos as c_custkey from g where kept""")
def greedy_dedupe(spark, sf_dir):
    """What one ordered pass keeps when either key may be seen only once."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 31 % 701).alias("ka"), (F.col("c_custkey") * 17 % 509).alias("kb"))
    return dedupe.greedy(c, "c_custkey", ["ka", "kb"]).select("c_custkey")


@query("""with r as (select c_nationkey, floor(c_acctbal / 100)::bigint as band, count(*) as n, min(c_mktsegment) as seg from customer group by all)
    select s_suppkey, coalesce(r.seg, 'unknown') as c_mktsegment from supplier s left join r on r.n = 1 and r.c_nationkey = s.s_nationkey and r.band = floor(s.s_acctbal / 100)::bigint""")
def unique_match_backfill(spark, sf_dir):
    """Suppliers filled from the only customer of their nation and balance band."""
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"))
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("band"), "c_mktsegment")
    return dedupe.unique_match(left, right, ["nation", "band"], "c_mktsegment", "unknown").select("s_suppkey", "c_mktsegment")


@query("""select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')
    and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)""")
def history_anti(spark, sf_dir):
    """Customers without history in either of two tables."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    return dedupe.exclude(table(spark, sf_dir, "customer").select("c_custkey"), (o.where("o_orderstatus = 'F'"), "c_custkey"), (o.where("o_totalprice > 400000"), "c_custkey"))


@query("""select c_custkey, case when c_acctbal > 0 and exists (select 1 from orders o where o.o_custkey = c.c_custkey) then 'KNOWN' else c_mktsegment end as c_mktsegment from customer c""")
def mark_known(spark, sf_dir):
    """Status set where the key is known and the row is open."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return dedupe.mark(c, known, "c_custkey", "c_mktsegment", F.lit("KNOWN"), F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment")


@query("""with last as (select o_custkey, arg_max(o_totalprice, o_orderkey) as last_price from orders group by 1)
    select c_custkey, last_price from customer left join last on c_custkey = o_custkey""")
def lookup_last(spark, sf_dir):
    """Look-up where the last row of a key wins."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", "o_orderkey").alias("last_price"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")


_TERMS = ["ing", "ble", "tion", "the", "es"]


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""select doc_id, len(list_filter({_TERMS!r}, lambda t: contains({_LOWER_SQL}, t))) as n_terms, array_to_string(list_filter({_TERMS!r}, lambda t: contains({_LOWER_SQL}, t)), ',') as terms,
    regexp_matches({_LOWER_SQL}, '(^|[^a-z])of[^a-z]+the([^a-z]|$)') as has_phrase from documents""")
def lexicon_hits_all(spark, sf_dir):
    """lexicon_hits over the documents of every language and of none; only A-Z are lower-cased."""
    low = text.ascii_lower(F.col("text"))
    hits = F.filter(F.array(*map(F.lit, _TERMS)), lambda t: F.contains(low, t))
    return table(spark, sf_dir, "documents").select("doc_id", _long(F.size(hits)).alias("n_terms"), F.array_join(hits, ",").alias("terms"), low.rlike("(^|[^a-z])of[^a-z]+the([^a-z]|$)").alias("has_phrase"))


_SCORE = "case when contains(p_type, 'STEEL') and p_size > 25 then 5 when contains(p_type, 'STEEL') then 4 when contains(p_brand, '1') then 3 when p_retailprice > 1000 then 2 else 1 end"


@query(f"select {_SCORE}::int as score, count(*) as n, min(p_partkey) as first_part from part group by 1")
def ordinal_score(spark, sf_dir):
    """A score of 1 to 5, first rule that holds (A2)."""
    steel = F.col("p_type").contains("STEEL")
    score = F.when(steel & (F.col("p_size") > 25), 5).when(steel, 4).when(F.col("p_brand").contains("1"), 3).when(F.col("p_retailprice") > 1000, 2).otherwise(1)
    return table(spark, sf_dir, "part").groupBy(score.alias("score")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


_RULES_SQL = "list_filter([case when l_discount > 0.08 then 'discount too high' end, case when l_quantity < 5 then 'quantity too low' end, case when l_returnflag = 'R' then 'returned' end, case when l_tax = 0 then 'tax missing' end], lambda x: x is not null)"


def _ruled(spark, sf_dir):
    rules = text.reasons((F.col("l_discount") > 0.08, "discount too high"), (F.col("l_quantity") < 5, "quantity too low"), (F.col("l_returnflag") == "R", "returned"), (F.col("l_tax") == 0, "tax missing"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.alias("reasons"))


@query(f"select l_orderkey, l_linenumber, len({_RULES_SQL}) = 0 as eligible, array_to_string({_RULES_SQL}, '; ') as reasons from lineitem")
def rule_reasons(spark, sf_dir):
    """Eligibility with every reason against, in order, for four constant rules."""
    return _ruled(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", "; ").alias("reasons"))


@query(f"select coalesce({_RULES_SQL}[1], 'eligible') as reason, count(*) as n from lineitem group by 1")
def reason_histogram(spark, sf_dir):
    """Rows by their first reason."""
    return _ruled(spark, sf_dir).groupBy(F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("select count(*) as total, count(*) filter (event_type = 'view') as unchecked, count(*) filter (event_type = 'purchase' or value > 100) as found from events")
def pool_metrics(spark, sf_dir):
    """Conditional counts in one pass (A1 A3 A4)."""
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("unchecked"), F.count_if((F.col("event_type") == "purchase") | (F.col("value") > 100)).alias("found"))


_YIELD_SQL = """y as (select user_id, count(*) as searches, count(*) filter (event_type = 'purchase') as emails, count(*) filter (event_type = 'signup') as leads,
      count(*) filter (event_id > coalesce((select max(e.event_id) from events e where e.user_id = events.user_id and e.event_type = 'purchase'), -1)) as zero_streak from events group by user_id)"""


def _yields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hit = F.col("event_type") == "purchase"
    sums = e.groupBy("user_id").agg(F.count("*").alias("searches"), F.count_if(hit).alias("emails"), F.count_if(F.col("event_type") == "signup").alias("leads"))
    return sums.join(state.trailing_zeros(state.zero_runs(e, "user_id", ["event_id"], hit), "user_id"), "user_id")


@query(f"with {_YIELD_SQL} select user_id, searches, emails, leads, zero_streak, zero_streak >= 3 as paused from y")
def yield_counters(spark, sf_dir):
    """Running sums of each query, its trailing zero streak and its pause."""
    return _yields(spark, sf_dir).withColumn("paused", F.col("zero_streak") >= 3)


@query("""with r as (select user_id, event_id, event_type, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as run from events),
    z as (select user_id, run, count(*) filter (event_type <> 'purchase') as zeros from r group by all)
    select user_id, sum(zeros // 3)::bigint as level, (arg_max(zeros, run) % 3)::bigint as streak from z group by 1""")
def zero_streak_growth(spark, sf_dir):
    """Growth state in closed form over runs without a hit."""
    return state.growth(state.zero_runs(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("event_type") == "purchase"), "user_id")


@query("""with n as (select max(ts) as now from events), m as (select user_id, event_type, max(bool_or(event_type = 'purchase')) over (partition by user_id) as ever,
      max(ts) filter (event_type <> 'purchase') as miss from events group by user_id, event_type)
    select user_id, event_type, case when ever then 'found' when now < miss + interval 14 day then 'cooldown' else 'retry' end as state from m, n""")
def negative_cache_ttl(spark, sf_dir):
    """Sticky hits and misses that expire after 14 days."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return state.negative_cache(e, "user_id", "event_type", "ts", F.col("event_type") == "purchase", now)


@query("select event_id, user_id from events e where event_type is distinct from 'purchase' and not exists (select 1 from events d where d.user_id = e.user_id and d.ts::date = e.ts::date and d.event_type = 'purchase')")
def resume_anti_all(spark, sf_dir):
    """resume_anti over all events: a purchase completes its user's day, every other event is to do (T5)."""
    task = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("ts").cast("date").cast("string"))
    e = table(spark, sf_dir, "events").withColumn("task", task)
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    return dedupe.exclude(e.where(~bought).select("event_id", "user_id", "task"), (e.where(bought), "task")).select("event_id", "user_id")


@query("select event_id, last_value(case when event_type in ('purchase','signup') then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as last_stage from events")
def checkpoint_carry(spark, sf_dir):
    """The last non-blank value carried forward (T4)."""
    value = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", state.carried(e, "user_id", ["event_id"], value).alias("last_stage"))


@query("""with t as (select event_id, floor(epoch(ts))::bigint as done, event_type <> 'error' as ok from events), d as (select *, done - event_id * 997 % 100000 + 20000 as due from t)
    select event_id, (case when not ok then done + 19800 when due <= done then due + 19800 * ((done - due) // 19800 + 1) else due end)::bigint as next_due from d""")
def cadence_next(spark, sf_dir):
    """Next due time after success and failure."""
    done = F.unix_timestamp(F.col("ts").cast("timestamp"))
    due = done - F.col("event_id") * 997 % 100_000 + 20_000
    return table(spark, sf_dir, "events").select("event_id", _long(state.next_due(due, done, F.col("event_type") != "error")).alias("next_due"))


@query("""with p as (select *, case event_type when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 when 'view' then 3 else 4 end as prio from events)
    select event_id, user_id, event_type from p qualify prio = min(prio) over (partition by user_id)""")
def provider_fallback(spark, sf_dir):
    """Rows of the first provider that answers a query."""
    prio = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    return state.fallback(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", prio.alias("prio")), "user_id", "prio").drop("prio")


@query("""select user_id, count(*) as attempts, max(event_id) as last_attempt from (select * from events
    qualify coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) < 2) group by 1""")
def circuit_breaker(spark, sf_dir):
    """Attempts before a provider's second failure."""
    e = state.circuit(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("event_type") == "error")
    return e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("event_id").alias("last_attempt"))


_SOURCES = [("everywhere", []), ("east", ["ASIA", "MIDDLE EAST"]), ("west", ["AMERICA", "EUROPE"]), ("south", ["AFRICA", "AMERICA"])]


@query(f"""with s(name, regions) as (values {", ".join(f"('{n}', {r!r}::varchar[])" for n, r in _SOURCES)})
    select n_name, name as source from nation join region on n_regionkey = r_regionkey join s on len(regions) = 0 or list_contains(regions, r_name)""")
def directory_region_join(spark, sf_dir):
    """Countries by the directories that cover their region (J10, part of G5)."""
    s = spark.createDataFrame(_SOURCES, "source string, regions array<string>").withColumn("r_name", F.explode_outer("regions"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    some = n.join(F.broadcast(s.where("r_name is not null")), "r_name").select("n_name", "source")  # as many rows as the constant has regions
    return some.unionByName(n.join(F.broadcast(s.where("r_name is null").select("source")), F.lit(True)).select("n_name", "source"))


@query(rf"""with t as (select doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[a-z]+tion[a-z]*')) as term from documents where source is distinct from 'src0'),
    known as (select distinct unnest(regexp_extract_all({_LOWER_SQL}, '[a-z]+tion[a-z]*')) as term from documents where source = 'src0'),
    d as (select doc_id, term from t where term not in (select term from known) group by all)
    select doc_id, term from d qualify row_number() over (partition by doc_id order by term) <= 6""")
def term_learning_all(spark, sf_dir):
    """term_learning over the documents of every language and of none; only A-Z are lower-cased."""
    d = table(spark, sf_dir, "documents")
    terms = lambda x: x.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text.ascii_lower(F.col("text")), F.lit("[a-z]+tion[a-z]*"), F.lit(0)))).alias("term"))
    known = F.coalesce(F.col("source") == "src0", F.lit(False))
    new = dedupe.exclude(terms(d.where(~known)), (terms(d.where(known)), "term"))
    return dedupe.within_quota(new, ["doc_id"], ["term"], 6).select("doc_id", "term")


@query("""with s as (select event_id, user_id, event_type, case when event_type = 'error' then 'invalid' when exists (select 1 from events h where h.user_id = events.user_id and h.event_type = 'purchase') then 'sent before'
      when row_number() over (partition by user_id, event_type <> 'error' order by event_id) > 1 then 'duplicate' else 'new' end as disposition from events)
    select disposition, count(*) as n from s group by 1""")
def seed_import_dispositions(spark, sf_dir):
    """Imported rows by what becomes of them."""
    e = table(spark, sf_dir, "events")
    sent = e.where("event_type = 'purchase'").select("user_id").distinct().withColumn("sent", F.lit(True))
    n = F.row_number().over(Window.partitionBy("user_id", F.col("event_type") != "error").orderBy("event_id"))
    disposition = F.when(F.col("event_type") == "error", "invalid").when(F.col("sent"), "sent before").when(F.col("n") > 1, "duplicate").otherwise("new")
    return e.withColumn("n", n).join(sent, "user_id", "left").groupBy(disposition.alias("disposition")).agg(F.count("*").alias("n"))


@query("""(select c_nationkey as nation, c_mktsegment as segment from customer where c_acctbal > 0 except select c_nationkey, c_mktsegment from customer where c_acctbal <= -500)
    union select s_nationkey, 'supplier' from supplier""")
def identity_difference(spark, sf_dir):
    """Pending identities less the baseline, and a union of sets."""
    c = table(spark, sf_dir, "customer")
    ids = lambda x: x.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return ids(c.where("c_acctbal > 0")).subtract(ids(c.where("c_acctbal <= -500"))).union(table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("supplier"))).distinct()


@query("""with n as (select greatest(0, least(50, count(*) // 100)) as capacity from orders where o_orderstatus = 'O')
    select o_orderkey, o_totalprice from orders, n qualify row_number() over (order by o_totalprice desc, o_orderkey) <= capacity""")
def topk_capacity(spark, sf_dir):
    """The best rows up to a capacity that the data sets."""
    o = table(spark, sf_dir, "orders")
    capacity = o.where("o_orderstatus = 'O'").agg(F.greatest(F.lit(0), F.least(F.lit(50), F.floor(F.count("*") / 100))).alias("capacity"))  # one row
    best = o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # never more than the largest capacity
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return best.join(F.broadcast(capacity), F.col("rank") <= F.col("capacity")).select("o_orderkey", "o_totalprice")


@query("""select (case when day <= 7 then 20 when day <= 14 then 50 else 100 end)::int as send_limit, count(*) as n from (select greatest(1, date_diff('day', (select min(ts) from events)::date, ts::date) + 1) as day from events) group by 1""")
def running_day_limit(spark, sf_dir):
    """Day since the start and the limit of that day."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").cast("date").alias("start"))  # one row
    day = F.greatest(F.lit(1), F.date_diff(F.col("ts").cast("date"), F.col("start")) + 1)
    return e.join(F.broadcast(start), F.lit(True)).groupBy(F.when(day <= 7, 20).when(day <= 14, 50).otherwise(100).alias("send_limit")).agg(F.count("*").alias("n"))


@query("""select event_type as provider, count(*) as requests, count(distinct user_id) as queries, arg_max(event_id, event_id) as last_event, round(sum(value) / greatest(1, count(*)), 6) as mean_value from events group by 1""")
def provider_usage(spark, sf_dir):
    """Use of each provider and its last row."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider"))
    return e.agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("queries"), F.max_by("event_id", "event_id").alias("last_event"), F.round(F.sum("value") / F.greatest(F.lit(1), F.count("*")), 6).alias("mean_value"))


@query("""select to_timestamp(floor(epoch(ts))::bigint // 19800 * 19800)::timestamp as cycle_start, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1""")
def cycle_metrics(spark, sf_dir):
    """Counts of each run cycle of 19,800 seconds (design of 2.12, T7)."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    start = F.timestamp_seconds(F.floor(F.col("t") / 19_800) * 19_800).cast("timestamp_ntz")
    return e.groupBy(start.alias("cycle_start")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""with b as (select event_type, count(*) as n from events group by 1)
    select 'events: ' || sum(n) as line from b union all select 'most frequent: ' || arg_min(event_type, lpad((1000000000000 - n)::varchar, 15, '0') || event_type) from b union all select event_type || ': ' || n from b""")
def daily_report(spark, sf_dir):
    """The run report as text lines."""
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n"))
    top = by.agg(F.sum("n").alias("total"), F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("best"), F.array_sort(F.collect_list(F.concat_ws(": ", "event_type", F.col("n").cast("string")))).alias("lines"))  # one line for each event type
    return top.select(F.explode(F.concat(F.array(F.format_string("events: %d", "total"), F.format_string("most frequent: %s", "best")), "lines")).alias("line"))


from recordweave.plans import prospects as _prospects  # noqa: E402, F401  (registers its queries here)
from recordweave.plans import discovery as _discovery  # noqa: E402, F401
from recordweave.plans import leads as _leads  # noqa: E402, F401
