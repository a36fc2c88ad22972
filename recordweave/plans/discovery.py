"""Queries of discovery and import: generated searches, directories resolved, mail recovery, imported seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordweave.functions import fixed, hosts, prospects
from recordweave.operators import dedupe
from recordweave.plans.catalog import _long, query, table
from recordweave.plans.prospects import _DRAFTS_SQL, _LINKS, _anchors_sql, _any, _drafts, _in, _values, attributable_sql, domain_sql, host_sql, q

_LEXICON_SQL = """lex as (select p_brand as industry, p_name as product, min(p_partkey) as first from part group by all), cat as (select industry, min(first) as rank, count(*) as n from lex group by 1),
    num as (select lex.industry, product, cat.rank, n, row_number() over (partition by lex.industry order by first) - 1 as pos from lex join cat using (industry)),
    named as (select lower(product) as key, arg_min(industry, rank) as industry, arg_min(pos, rank) as start from num group by 1),
    asked as (select c_custkey, n_name as country, case when c_custkey % 4 = 0 then 'COLD Widget' when c_custkey % 9 = 0 then 'Marine' else 'Brand#' || (1 + c_custkey % 30) end as industry from customer join nation on c_nationkey = n_nationkey),
    placed as (select asked.*, coalesce(cat.industry, named.industry) as category, case when cat.industry is null then coalesce(start, 0) else 0 end as start, coalesce(c2.n, 1) as n from asked
      left join cat on asked.industry = cat.industry left join named on lower(asked.industry) = named.key left join cat c2 on c2.industry = coalesce(cat.industry, named.industry)),
    found as (select c_custkey, country, placed.industry, coalesce(product, placed.industry) as product from placed left join num on num.industry = category and num.pos = (start + c_custkey) % placed.n)"""


def _asked(spark, sf_dir):
    """c_custkey, country, industry, product: the product that the rotation (the key) takes of the industry's own, else of the first category that has one of that name, from it on."""
    lex = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_name").alias("product")).agg(F.min("p_partkey").alias("first"))
    cat = lex.groupBy("category").agg(F.min("first").alias("rank"), F.count("*").alias("n"))
    num = lex.join(cat, "category").withColumn("pos", F.row_number().over(Window.partitionBy("category").orderBy("first")) - 1)
    named = num.groupBy(F.lower("product").alias("key")).agg(F.min_by(F.struct("category", "pos", "n"), "rank").alias("by"))
    k, sizes = F.col("c_custkey"), cat.select(F.col("category").alias("industry"), F.col("n").alias("own"))
    industry = F.when(k % 4 == 0, "COLD Widget").when(k % 9 == 0, "Marine").otherwise(F.concat(F.lit("Brand#"), (1 + k % 30).cast("string")))
    asked = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), industry.alias("industry"))
    placed = asked.join(sizes, "industry", "left").withColumn("key", F.lower("industry")).join(named, "key", "left")
    own = F.col("own").isNotNull()
    start, n = F.when(own, 0).otherwise(F.coalesce("by.pos", F.lit(0))), F.coalesce("own", "by.n", F.lit(1))
    placed = placed.select("c_custkey", "country", "industry", F.when(own, F.col("industry")).otherwise(F.col("by.category")).alias("category"), ((start + k) % n).alias("pos"))
    return placed.join(num.select("category", "pos", "product"), ["category", "pos"], "left").select("c_custkey", "country", "industry", F.coalesce("product", "industry").alias("product"))


def _picked(values: tuple[str, ...], shift: int = 0) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("c_custkey") + shift) % len(values) + 1).cast("int"))


def _picked_sql(values: tuple[str, ...], shift: int = 0) -> str:
    return f"([{', '.join(map(q, values))}])[((c_custkey + {shift}) % {len(values)}) + 1]"


def _filled(template: str, parts: dict[str, F.Column]) -> F.Column:
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def _filled_sql(template: str, parts: dict[str, str]) -> str:
    out = q(template)
    for k, v in parts.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


def _lists_sql() -> str:
    parts = {"c": "country", "i": "industry", "p": "product", "j": _picked_sql(fixed.JOBS), "b": _picked_sql(fixed.PROCUREMENT), "x": _picked_sql(fixed.ROTATING_PRODUCTS), "y": _picked_sql(fixed.ROTATING_PRODUCTS, 1)}
    return " union all ".join(f"select c_custkey, {q(kind)} as kind, [{', '.join(_filled_sql(t, parts) for t in ts)}] as l from found" for kind, ts in fixed.TEMPLATES.items())


@query(f"""with {_LEXICON_SQL}, lists as ({_lists_sql()}), u as (select c_custkey, kind, list_filter(l, lambda x, i: list_position(l, x) = i) as l from lists)
    select c_custkey, kind, unnest(l) as query, generate_subscripts(l, 1) - 1 as pos from u""")
def generated_queries(spark, sf_dir):
    """The searches generated for each (country, industry, rotation), in order and once each: batch, mail first, and prospects without their directory part."""
    a = _asked(spark, sf_dir)
    parts = {"c": F.col("country"), "i": F.col("industry"), "p": F.col("product"), "j": _picked(fixed.JOBS), "b": _picked(fixed.PROCUREMENT), "x": _picked(fixed.ROTATING_PRODUCTS), "y": _picked(fixed.ROTATING_PRODUCTS, 1)}
    lists = F.array(*(F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.array(*(_filled(t, parts) for t in ts))).alias("l")) for kind, ts in fixed.TEMPLATES.items()))
    e = a.select("c_custkey", F.explode(lists).alias("g")).select("c_custkey", "g.kind", F.posexplode("g.l").alias("pos", "query"))
    return e.select("c_custkey", "kind", "query", _long("pos").alias("pos"))


@query(f"""with h as (select distinct {host_sql("url")} as host from pages), l as (select host, ['"@' || host || '"', {", ".join(f"'site:' || host || ' {chr(34)}{x}{chr(34)}'" for x in fixed.INTENTS)}, 'site:' || host || ' filetype:pdf email OR contact'] as l from h where host <> '')
    select host, unnest(l) as query, generate_subscripts(l, 1) - 1 as pos from l""")
def domain_queries(spark, sf_dir):
    """The eight searches that look for one host's mailboxes."""
    h = table(spark, sf_dir, "pages").select(hosts.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    site = lambda x: F.concat(F.lit("site:"), F.col("host"), F.lit(" " + x))
    all_ = F.array(F.concat(F.lit('"@'), F.col("host"), F.lit('"')), *(site(f'"{x}"') for x in fixed.INTENTS), site("filetype:pdf email OR contact"))
    return h.select("host", F.posexplode(all_).alias("pos", "query")).select("host", "query", _long("pos").alias("pos"))


@query(f"""with {_anchors_sql()}, o as (select page_id, url, {domain_sql(host_sql("url"))} as own from pg), d as (select z.page_id, pos, case when {_any("label", fixed.SITE_LABELS)} then 0 else 1 end as worse, {domain_sql(host_sql("href"))} as domain from z),
    best as (select d.page_id, arg_min(domain, worse * 1000000 + pos) as domain from d join o using (page_id) where domain <> '' and domain <> own and domain not in {_in(fixed.OUTBOUND)} and domain not in {_in(fixed.DIRECTORIES)} group by 1)
    select o.page_id, case when own not in {_in(fixed.DIRECTORIES)} then url else 'https://' || domain end as target from o left join best using (page_id)""")
def directory_targets(spark, sf_dir):
    """What a result leads to: itself, or for a directory's page the best link to a company, one labelled as its site first; null without any."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(_LINKS, "page_id long, url string, html string"))
    domain = lambda c: hosts.registrable_domain(hosts.host(c))
    links = F.transform(
        prospects.anchors(F.col("html"), F.col("url")), lambda x, i: F.struct(F.when(prospects.contains_any(x["label"], fixed.SITE_LABELS), 0).otherwise(1).alias("worse"), i.alias("pos"), domain(x["href"]).alias("domain"))
    )
    fit = F.filter("links", lambda x: (x["domain"] != "") & (x["domain"] != F.col("own")) & ~x["domain"].isin(*fixed.OUTBOUND) & ~prospects.directory(x["domain"]))
    p = p.select("page_id", "url", domain(F.col("url")).alias("own"), links.alias("links"))
    return p.select("page_id", F.when(~prospects.directory(F.col("own")), F.col("url")).otherwise(F.concat(F.lit("https://"), F.array_min(fit)["domain"])).alias("target"))


_PLACES = [(-1, "Büro in München, Berlin"), (-2, "Offices: EINDHOVEN and London"), (-3, "Londonderry"), (-4, "Göteborg"), (-5, "Cambridge, UK")]


def _city(names: tuple[str, ...]) -> str:
    return rf"(?:^|[^\pL\pN_])({'|'.join(names)})(?:$|[^\pL\pN_])"


@query(f"""with t as (select doc_id, coalesce(text, '') as text from documents union all select * from ({_values(_PLACES)}))
    select doc_id, coalesce({", ".join(f"nullif(regexp_extract(text, {q('(?i)' + _city(c))}, 1), '')" for c in fixed.CITIES)}, 'Not Found') as city from t""")
def cities(spark, sf_dir):
    """The first city of each text, of the first list that has one."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(spark.createDataFrame(_PLACES, "doc_id long, text string"))
    found = (F.nullif(F.regexp_extract("text", "(?iu)" + _city(c), 1), F.lit("")) for c in fixed.CITIES)
    return t.select("doc_id", F.coalesce(*found, F.lit("Not Found")).alias("city"))


@query(f"""with {_DRAFTS_SQL}, c as (select id, domain from dr where status = '' and lower(email) in ('', 'not found') and domain <> ''),
    m as (select id, domain, unnest(['noreply@' || domain, 'jo@gmx.com', 'x@other.example', case when id % 2 = 0 then 'Sales@' || domain else 'legal@' || domain end]) as raw, unnest([0, 1, 2, 3]) as pos from c),
    f as (select id, arg_min(lower(raw), pos) as email from m where split_part(raw, '@', 2) not in {_in(fixed.FREE)} and lower(split_part(raw, '@', 1)) not in {_in(fixed.NO_RECOVERY)} and {attributable_sql("split_part(raw, '@', 2)", "domain")} group by 1)
    select c.id, coalesce(f.email, 'Not Found') as email, case when f.email is null then 'Contact Form Only / Manual Email Needed' else '' end as reason from c left join f using (id)""")
def mail_recovery(spark, sf_dir):
    """Unsent drafts without an address, and the first mailbox of the company that their pages offer (F3 F5 F22 J13; pages are made up)."""
    d, dom = _drafts(spark, sf_dir).where((F.col("status") == "") & F.lower("email").isin("", "not found") & (F.col("domain") != "")), F.col("domain")
    at = lambda local: F.concat(F.lit(local + "@"), dom)
    offered = F.array(at("noreply"), F.lit("jo@gmx.com"), F.lit("x@other.example"), F.when(F.col("id") % 2 == 0, at("Sales")).otherwise(at("legal")))
    mails = F.transform(offered, F.lower)
    fit = F.filter(mails, lambda m: prospects.valid_email(m) & ~hosts.mailbox_domain(hosts.mailbox(m)).isin(*fixed.FREE) & ~F.split_part(m, F.lit("@"), F.lit(1)).isin(*fixed.NO_RECOVERY) & hosts.attributable(hosts.mailbox_domain(hosts.mailbox(m)), dom))
    best = F.try_element_at(fit, F.lit(1))
    return d.select("id", F.coalesce(best, F.lit("Not Found")).alias("email"), F.when(best.isNull(), "Contact Form Only / Manual Email Needed").otherwise("").alias("reason"))


@query("""with r as (select user_id, event_type, min(event_id) as first, count(*) filter (event_type = 'purchase') as sends from events group by all)
    select user_id, event_type, case when row_number() over (partition by user_id order by first) = 1 then sum(sends) over (partition by user_id) else 0 end::bigint as sends from r""")
def send_attribution(spark, sf_dir):
    """Sends of each query, all counted at the first record of that query whatever its source."""
    r = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.count_if(F.col("event_type") == "purchase").alias("sends"))
    w = Window.partitionBy("user_id")
    return r.select("user_id", "event_type", F.when(F.row_number().over(w.orderBy("first")) == 1, F.sum("sends").over(w)).otherwise(0).alias("sends"))


@query(f"""with r as (select p_partkey, p_brand as query, length(p_brand) > 7 as later, 'https://e' || (p_partkey % 97) || '.example' as url, lower(p_name || case when p_partkey % 3 = 0 then ' sensor' else '' end) as low from part),
    n as (select greatest(4, ceil(120.0 / greatest(1, count(distinct query)))) as per from r), k as (select *, row_number() over (partition by query order by p_partkey) as pos from r),
    f as (select * from k, n where pos <= per and {_any("low", fixed.HARDWARE)} qualify row_number() over (partition by url order by later, query, pos) = 1)
    select p_partkey, query, url from f order by later, query, pos limit 120""")
def directory_candidates(spark, sf_dir):
    """Results of direct queries, then of the others: so many a query, hardware alone, each URL where first seen, 120 in all (W11; the limits are the feature)."""
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " sensor").otherwise(""))
    r = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("query"), (F.length("p_brand") > 7).alias("later"), F.concat(F.lit("https://e"), (F.col("p_partkey") % 97).cast("string"), F.lit(".example")).alias("url"), title.alias("title"))
    per = r.agg(F.greatest(F.lit(4), F.ceil(F.lit(120) / F.greatest(F.lit(1), F.count_distinct("query")))).alias("per"))  # one row
    k = r.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("p_partkey"))).where("pos <= 120")  # never more than the cap
    k = k.join(F.broadcast(per), F.col("pos") <= F.col("per")).where(prospects.contains_any(F.lower("title"), fixed.HARDWARE))
    return dedupe.first_by(k, ["url"], ["later", "query", "pos"]).orderBy("later", "query", "pos").limit(120).select("p_partkey", "query", "url")


@query(rf"""with c as (select s_suppkey, s_name, 'Info@My-Shop' || s_suppkey || '.example; x, sales@b.my-shop' || s_suppkey || '.example' as cell, case when s_suppkey % 2 = 0 then '' else 'www.my-shop' || s_suppkey || '.example/' end as site from supplier),
    m as (select *, lower(unnest(regexp_extract_all(cell, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}'))) as email from c), d as (select *, {domain_sql("split_part(email, '@', 2)")} as domain from m)
    select s_suppkey, email, domain, case when s_suppkey % 3 = 0 then s_name else array_to_string(list_transform(string_split(replace(replace(split_part(domain, '.', 1), '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end as company,
      case when {domain_sql(host_sql("site"))} = domain then 'https://' || rtrim(site, '/') else 'https://' || domain end as website from d""")
def seed_mails(spark, sf_dir):
    """Every mailbox of imported cells, with the domain, name and site it is imported under."""
    from recordweave.sources import seeds

    key = F.col("s_suppkey").cast("string")
    cell = F.concat(F.lit("Info@My-Shop"), key, F.lit(".example; x, sales@b.my-shop"), key, F.lit(".example"))
    site = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit("www.my-shop"), key, F.lit(".example/")))
    c = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("company_name"), site.alias("website"), F.lit("").alias("domain"), F.array(cell).alias("email"))
    return seeds.mails(c).select("s_suppkey", "email", "domain", "company", "website")


@query(f"""with {_DRAFTS_SQL}, first as (select lower(email) as email, arg_min(id, id) as id, arg_min(status, id) as status, arg_min(email_type, id) as email_type from dr where lower(email) not in ('', 'not found') group by 1)
    select o_orderkey, first.id as draft, coalesce(first.status, '') as status, coalesce(email_type, 'Not Found') as email_type from orders left join first on first.email = 'info@cust' || o_custkey || '.example'""")
def report_status(spark, sf_dir):
    """Each report row with the state of the first draft of its address."""
    d = _drafts(spark, sf_dir).withColumn("email", F.lower("email")).where(~F.col("email").isin("", "not found"))
    first = d.groupBy("email").agg(F.min(F.struct("id", "status", "email_type")).alias("d"))  # partial minima: a common address is one row a task
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("info@cust"), F.col("o_custkey").cast("string"), F.lit(".example")).alias("email"))
    return o.join(first, "email", "left").select("o_orderkey", F.col("d.id").alias("draft"), F.coalesce("d.status", F.lit("")).alias("status"), F.coalesce("d.email_type", F.lit("Not Found")).alias("email_type"))


@query(f"""with e as (select event_id, event_type, 'u' || user_id || '.example' as domain from events),
    m as (select *, case event_type when 'click' then 'Info@' || domain when 'signup' then 'jo@sub.' || domain when 'error' then 'x@gmx.de' when 'view' then 'bad@@' || domain else 'sales@' || domain end as email from e),
    k as (select *, lower(email) as mail, regexp_matches(email, '^[^@]+@[^@]+$') and split_part(email, '@', 2) not in {_in(fixed.FREE)} and {attributable_sql("split_part(email, '@', 2)", "domain")} as ok from m)
    select domain, coalesce(arg_min(mail, event_id) filter (ok), '') as email, count(*) as offered, count(*) filter (ok) as usable from k group by 1""")
def enrichment_lookup(spark, sf_dir):
    """The first usable mailbox that an outside list offers for each domain, and how many it offered (J14; the list is made up of events)."""
    t, dom = F.col("event_type"), F.col("domain")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"))
    at = lambda local: F.concat(F.lit(local), dom)
    mail = F.lower(F.when(t == "click", at("Info@")).when(t == "signup", at("jo@sub.")).when(t == "error", "x@gmx.de").when(t == "view", at("bad@@")).otherwise(at("sales@")))
    host = hosts.mailbox_domain(hosts.mailbox(F.col("mail")))  # empty unless it is a mailbox
    e = e.withColumn("mail", mail).withColumn("ok", prospects.valid_email(F.col("mail")) & ~host.isin(*fixed.FREE) & hosts.attributable(host, dom))
    best = F.min(F.when(F.col("ok"), F.struct("event_id", "mail")))
    return e.groupBy("domain").agg(F.coalesce(best["mail"], F.lit("")).alias("email"), F.count("*").alias("offered"), F.count_if("ok").alias("usable"))


@query(f"""with d as (select page_id, url, {domain_sql(host_sql("url"))} as domain from pages), f as (select domain, arg_min(url, page_id) as url, min(page_id) as page_id from d where domain <> '' group by 1)
    select page_id, domain, 'https://' || domain as website, 'Not Found' as email, 'Not Found' as phone, url as source_links, 4 as score from f""")
def seed_leads(spark, sf_dir):
    """Results as leads, one for each domain where first seen; what isn't known is a fixed value."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", hosts.registrable_domain(hosts.host(F.col("url"))).alias("domain")).where("domain <> ''")
    first = p.groupBy("domain").agg(F.min(F.struct("page_id", "url")).alias("p"))
    unknown = F.lit("Not Found")
    return first.select("p.page_id", "domain", F.concat(F.lit("https://"), "domain").alias("website"), unknown.alias("email"), unknown.alias("phone"), F.col("p.url").alias("source_links"), F.lit(4).alias("score"))
