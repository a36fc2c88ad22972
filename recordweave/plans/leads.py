"""Queries of composed discovery: resolution before enrichment, contact chains, link frontiers and run budgets over all pages.

As the pages link to none of each other and hold few contacts, some made-up ones are added, in Spark and SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.functions import fixed, hosts, markup, prospects, sites
from recordweave.operators import budget, chain, dedupe
from recordweave.plans.catalog import _long, query, table
from recordweave.plans.catalog import visible_sql
from recordweave.plans.prospects import _TITLE_SQL, _any, _in, _mails_sql, _values, attributable_sql, domain_sql, host_sql, q

_MADE = [
    (-300, "https://one.example/p", "<title>One Sensors</title>Write to info@one.example or jobs@one.example"), (-299, "https://www.two.example/x#top", "<title>Two Drives</title>motor drives, see gmx@gmx.com"),
    (-298, "https://three.example/", "<title>Three</title><a href='/contact-form'>Contact</a> robots"), (-297, "https://four.example/a", "<title>Four, PCB manufacturer</title>"), (-296, "https://clutch.co/z", "<title>Clutch</title>x"),
    (-295, "https://b.example/1", "<title>Suppliers</title>"), (-294, "https://gone.example/1", "<title>Gone</title>info@gone.example"), (-293, "https://old.example/1", "<title>Old</title>"), (-292, "https://one.example/q", "<title>One again</title>"),
    (-291, "https://five.de/", "<title>Five</title>"), (-290, "https://six.example/", "<title>Six</title>bob@other.example"), (-289, "https://seven.example/", "<title>Seven</title>"),
    (-200, "https://www.two.example/contact/", "other@else.example sales@two.example"), (-199, "https://www.two.example/about", "hello@two.example"), (-198, "https://three.example/contact", "<a href='/request'>Request</a>"), (-197, "https://three.example/support", "<a href='/request'>Request</a>"),
    (-196, "https://three.example/team", "zoe@three.example"), (-195, "https://three.example/about-us", "<p>Kim.lee@three.example, Office@three.example</p>"), (-194, "https://five.de/impressum", "Impressum kontakt@five.de"), (-193, "https://five.de/contact", "info@five.de"),
    (-192, "https://six.example/contact", "nobody here"), (-191, "https://seven.example/about", "<a href='/inquiry'>write</a>"), (-190, "https://seven.example/legal", "seven@gmx.com"),
    (-150, "https://links.example/", "<a href='/a'>a</a><a href='b#x'>b</a><a href='https://far.example/'>far</a><a href='/missing'>m</a>"), (-149, "https://links.example/a", "<a href='/c'>c</a><a href='/'>up</a><a href='/b'>b</a>"), (-148, "https://links.example/b", "<a href='/d'>d</a><a href='/c'>c</a>"),
    (-147, "https://links.example/c", "<a href='/e'>e</a>"), (-146, "https://links.example/d", "<a href='/e'>e</a>"), (-145, "https://links.example/e", ""), (-144, "https://far.example/", "<a href='/1'>1</a><a href='https://links.example/a'>a</a>"), (-143, "https://far.example/1", "<a href='/2'>2</a>"), (-142, "https://far.example/2", ""),
]
_EXISTING, _SENT = ("old.example",), ("gone.example",)
_KEY_SQL = r"regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"
_PAGES_SQL = f"pg as (select page_id as id, coalesce(url, '') as url, coalesce(html, '') as html from pages union all select * from ({_values(_MADE)}))"


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return p.unionByName(spark.createDataFrame(_MADE, "id long, url string, html string"))


_RANK_SQL = "case email_type when 'Generic Company Email' then 1 when 'Public Work Email' then 2 else 3 end"


def _paths_sql(table_: str, lists: dict[str, tuple[str, ...]]) -> str:
    rows = ", ".join(f"({q(name)}, {i}, {q(path)})" for name, paths in lists.items() for i, path in enumerate(paths))
    return f"{table_}(kind, rank, path) as (values {rows})"


@query(f"""with {_PAGES_SQL}, pt as (select id, url, html, {_TITLE_SQL} as title, left({visible_sql("html")}, 200) as snippet, {host_sql("url")} as host from pg),
    ms as (select id * 2 as id, title || ' ' || snippet || ' ' || url as t from pt union all select id * 2 + 1, html from pt), {_mails_sql("select id, t from ms")},
    ty as (select *, {_RANK_SQL} as pr from typed where email_type is not null),
    rs as (select *, {domain_sql("host")} as dom, trim(lower(translate(title, 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'))) as plain, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, {_KEY_SQL} as page_key from pt),
    rr as (select *, case when dom in {_in(fixed.NOT_COMPANIES)} or plain in {_in(fixed.LISTING_TITLES)} or {_any("plain", fixed.LISTINGS)} then 'non-company result' when {_any("lower(title || ' ' || snippet)", fixed.PEERS)} then 'PCB/EMS peer'
        when dom in {_in(_SENT)} then 'sent history domain' when dom = '' or dom in {_in(_EXISTING)} then 'missing or duplicate domain' end as reason from rs),
    ac as (select *, coalesce(reason, case when row_number() over (partition by reason is null, dom order by id) = 1 then 'accepted' else 'missing or duplicate domain' end) as outcome from rr),
    sn as (select a.id, arg_min(e, t.pr || e) as email from ac a join ty t on t.id = a.id * 2 where outcome = 'accepted' and t.domain not in {_in(fixed.FREE)} and {attributable_sql("t.domain", "a.host")} group by 1),
    {_paths_sql("pa", {"de": fixed.GERMAN_PATHS, "en": fixed.OTHER_PATHS, "second": fixed.SECOND_PATHS})},
    vi as (select a.id, a.host, pa.kind, pa.rank, p.id as page, p.html from ac a join pa on pa.kind = 'second' or pa.kind = (case when ends_with(a.host, '.de') then 'de' else 'en' end) join rs p on p.page_key = a.origin || '/' || pa.path where a.outcome = 'accepted' and a.id not in (select id from sn)),
    hit as (select v.id, v.kind = 'second' as later, v.rank, arg_min(e, t.pr || e) as email from vi v join ty t on t.id = v.page * 2 + 1 where t.domain not in {_in(fixed.FREE)} and {attributable_sql("t.domain", "v.host")} group by all),
    first as (select id, min(rank) as rank, arg_min(email, rank) as email from hit where not later group by 1),
    form as (select distinct id from vi v where kind <> 'second' and not exists (select 1 from ty t where t.id = v.page * 2 + 1) and regexp_matches(lower(html), '<a href=''[^'']*(?:/contact|/kontakt|contact-form|inquiry|enquiry)|<a [^>]*>[^<]*(?:contact|kontakt|inquiry|enquiry|request)[^<]*</a>')),
    second as (select id, min(rank) as rank, arg_min(email, rank) as email from hit where later and id in (select id from form) and id not in (select id from first) group by 1),
    ev as (select v.id, count(distinct html) as n from vi v left join first f using (id) left join second s on s.id = v.id
           where html <> '' and (v.kind <> 'second' and v.rank <= coalesce(f.rank, 99) or v.kind = 'second' and f.id is null and v.id in (select id from form) and v.rank <= coalesce(s.rank, 99)) group by 1)
    select a.id, a.outcome, coalesce(sn.email, first.email, second.email) as email, case when sn.id is not null then 'search result' when first.id is not null then 'contact page' when second.id is not null then 'secondary page' end as branch, coalesce(ev.n, 0) as n_evidence
    from ac a left join sn using (id) left join first on first.id = a.id left join second on second.id = a.id left join ev on ev.id = a.id""")
def lead_chain(spark, sf_dir):
    """Every result's outcome, and for those accepted the first contact along the chain of its pages.

    First all domains are settled: what is no company's result, a peer, sent to or known
    goes, then all but the first of a domain.  Then contacts are sought in the result, then
    on contact pages in their order, then, where one of these has a form alone, on secondary
    pages.  n_evidence counts the different official pages read on the way.
    """
    c, pages = F.col, _pages(spark, sf_dir)
    rows = pages.select("id", "url", markup.read(c("html")).alias("p"), F.get(sites.of(c("url")), F.lit(0)).alias("s"))
    rows = rows.select("id", "url", c("p.title").alias("title"), F.substring("p.text", 1, 200).alias("snippet"), F.coalesce("s.host", F.lit("")).alias("host"), F.coalesce("s.domain", F.lit("")).alias("domain"))
    rows = rows.withColumn("origin", F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1))
    peer = prospects.contains_any(F.lower(F.concat_ws(" ", "title", "snippet")), fixed.PEERS)
    reason = chain.first_reason((~prospects.company_result(c("title"), c("domain")), "non-company result"), (peer, "PCB/EMS peer"))
    known = lambda names: spark.createDataFrame([(n,) for n in names], "domain string")
    settled = chain.keep(chain.resolved(rows, reason, "id", "domain", known(_EXISTING), known(_SENT)))
    by_key = pages.select(hosts.page_key(c("url")).alias("page_key"), c("url").alias("page_url"), "html")
    visited = {}

    def own(contacts):
        mail = lambda x: prospects.email_domain(x["email"])
        found = F.filter(contacts, lambda x: (x["email"] != "Not Found") & ~mail(x).isin(*fixed.FREE) & hosts.attributable(mail(x), c("host")))
        return F.try_element_at(found, F.lit(1))["email"]

    def in_result(left):
        return left.select("id", own(prospects.contacts(F.concat_ws(" ", "title", "snippet", "url"), F.lit(""))).alias("email"), F.lit(0).alias("rank")).where("email is not null")

    def on_pages(left, name, paths):
        at = chain.pages_at(left, by_key, paths)
        read = at.withColumn("contacts", prospects.contacts(c("html"), prospects.form_url(prospects.anchors(c("html"), c("page_url"))))).join(left.select("id", "host"), "id")
        visited[name] = chain.keep(read.select("id", "rank", "html", own(c("contacts")).alias("email"), F.exists("contacts", lambda x: x["email_type"] == "Contact Form Only").alias("form")))
        return dedupe.first_by(visited[name].where("email is not null"), ["id"], ["rank"]).select("id", "email", "rank")

    def contact_pages(left):
        paths = F.when(c("host").endswith(".de"), F.array(*map(F.lit, fixed.GERMAN_PATHS))).otherwise(F.array(*map(F.lit, fixed.OTHER_PATHS)))
        return on_pages(left, "first", paths)

    def secondary_pages(left):
        return on_pages(left.join(visited["first"].where("form").select("id").distinct(), "id", "left_semi"), "second", F.array(*map(F.lit, fixed.SECOND_PATHS)))

    found = chain.fall_through(settled.where("outcome = 'accepted'"), "id", [("search result", in_result), ("contact page", contact_pages), ("secondary page", secondary_pages)])
    seen = None
    for name, branch in (("first", "contact page"), ("second", "secondary page")):
        until = found.where(c("branch") == branch).select("id", c("rank").alias("until"))
        part = visited[name].join(until, "id", "left").where((F.coalesce("until", F.lit(99)) >= c("rank")) & (c("html") != "")).select("id", "html")
        seen = part if seen is None else seen.unionByName(part)
    evidence = seen.groupBy("id").agg(F.count_distinct("html").alias("n_evidence"))
    return settled.select("id", "outcome").join(found.select("id", "email", "branch"), "id", "left").join(evidence, "id", "left").select("id", "outcome", "email", "branch", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


_DEPTH, _PER_HOST = 2, 4


def _step_sql(n: int) -> str:
    before = " union all ".join(f"select page_key, dom from s{k}" for k in range(n))
    return f"""a{n} as (select l.target as page_key, l.page_key as src, l.pos, row_number() over (partition by l.target order by l.page_key, l.pos) as first from lk l join s{n - 1} s using (page_key) where l.target not in (select page_key from ({before}))),
    b{n} as (select a.page_key, k.dom, a.src, a.pos, row_number() over (partition by k.dom order by a.src, a.pos, a.page_key) as r from a{n} a join ks k on k.page_key = a.page_key where first = 1),
    s{n} as (select b.page_key, b.dom, b.src, b.pos, {n} as step from b{n} b left join (select dom, count(*) as had from ({before}) group by 1) h using (dom) where r + coalesce(had, 0) <= {_PER_HOST})"""


_HREF_SQL = "(?i)<a\\s(?:[^<>]*?\\s)?href\\s*=\\s*(\"[^\"<>]*\"|''[^''<>]*''|[^\\s\"''<>]+)"


@query(rf"""with {_PAGES_SQL}, ks as (select {_KEY_SQL} as page_key, {domain_sql(host_sql("url"))} as dom, min(id) as id from pg group by 1, 2),
    raw as (select id, url, {_KEY_SQL} as page_key, generate_subscripts(regexp_extract_all(html, '{_HREF_SQL}', 1), 1) as pos, trim(unnest(regexp_extract_all(html, '{_HREF_SQL}', 1)), '"''') as h from pg),
    full_ as (select page_key, pos, case when regexp_matches(h, '^[a-z]+:') then h when starts_with(h, '//') then regexp_extract(url, '^([a-z]+:)', 1) || h when starts_with(h, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h else regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || h end as url from raw),
    lk as (select page_key, pos, {_KEY_SQL} as target from full_), sd as (select page_key, dom, row_number() over (partition by dom order by id) as r from ks),
    s0 as (select page_key, dom, '' as src, 0 as pos, 0 as step from sd where r = 1), {", ".join(_step_sql(n) for n in range(1, _DEPTH + 1))},
    al as ({" union all ".join(f"select * from s{n}" for n in range(_DEPTH + 1))})
    select page_key, step, row_number() over (partition by dom order by step, src, pos, page_key) as place from al""")
def link_frontier(spark, sf_dir):
    """The pages that links lead to from the first page of each domain, two steps deep, four of a domain at most."""
    c = F.col
    p = _pages(spark, sf_dir).select("id", hosts.page_key(c("url")).alias("page_key"), F.get(sites.of(c("url")), F.lit(0)).alias("s"), markup.page(c("html"), c("url")).alias("p"))
    p = p.select("id", "page_key", F.coalesce("s.domain", F.lit("")).alias("host"), F.transform("p.anchors", lambda a: hosts.page_key(a["href"])).alias("links"))
    pages = chain.keep(dedupe.first_by(p, ["page_key"], ["id"]))
    seeds = dedupe.first_by(pages, ["host"], ["id"]).select("page_key")
    return chain.frontier(pages, seeds, _DEPTH, _PER_HOST).select("page_key", "step", _long("place").alias("place"))


_RUN, _DOMAIN_PAGES = 300, 5


@query(rf"""with {_PAGES_SQL}, k as (select id, {_KEY_SQL} as page_key, {domain_sql(host_sql("url"))} as dom, {host_sql("url")} as host from pg), u as (select *, row_number() over (partition by page_key order by id) as nth from k),
    d as (select id, row_number() over (partition by host order by id) as of_host from u where nth = 1), w as (select id, case when of_host = 1 then 2 else 1 end as cost from d where of_host <= {_DOMAIN_PAGES}),
    t as (select id, sum(cost) over (order by id) as spent from w)
    select id, spent::bigint as spent, spent <= {_RUN} as allowed from t""")
def run_budget(spark, sf_dir):
    """Which fetches of a run its shared budget covers: each URL once, five of a host, the first of a host costing two."""
    c = F.col
    p = _pages(spark, sf_dir).select("id", hosts.page_key(c("url")).alias("page_key"), hosts.host(c("url")).alias("host"))
    once = dedupe.within_quota(dedupe.first_by(p, ["page_key"], ["id"]), ["host"], ["id"], _DOMAIN_PAGES)
    first = once.groupBy("host").agg(F.min("id").alias("first"))
    cost = once.join(first, "host").select("id", F.when(c("id") == c("first"), 2).otherwise(1).alias("cost"))
    return budget.running_total(cost, ["id"], c("cost")).select("id", "spent", (c("spent") <= _RUN).alias("allowed"))
