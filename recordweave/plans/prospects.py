"""Queries of the record rules: qualification, names, contacts, links, sources, sending, ranking.

Where the tables hold no such texts, a few made-up rows that exercise each rule are added
to the whole table; each query's SQL adds the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from recordweave.functions import evidence, fixed, hosts, html, markup, prospects, sites
from recordweave.plans.catalog import _CLEAN, _long, query, table
from recordweave.plans.catalog import visible_sql as _visible


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return f"({', '.join(map(q, values))})"


def _hits(source: str, patterns: dict[str, str]) -> str:
    cases = ", ".join(f"case when regexp_matches({source}, {q(p)}) then {q(s)} end" for s, p in patterns.items())
    return f"list_filter([{cases}], lambda x: x is not null)"


def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join(f"({', '.join(q(v) if isinstance(v, str) else str(v) for v in r)})" for r in rows)


def host_sql(x: str) -> str:
    return rf"regexp_replace(regexp_extract(lower(trim({x})), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^www\.', '')"


def domain_sql(h: str) -> str:
    labels = f"string_split({h}, '.')"
    two = f"array_to_string(list_slice({labels}, -2, -1), '.')"
    return f"case when len({labels}) < 2 then '' when {two} not in {_in(hosts.SUFFIXES)} then {two} when len({labels}) < 3 then '' else array_to_string(list_slice({labels}, -3, -1), '.') end"


def attributable_sql(a: str, b: str) -> str:
    return f"({domain_sql(a)} = {domain_sql(b)} and {domain_sql(a)} <> '' and ({a} = {b} or ends_with({b}, '.' || {a})))"


def _identities_sql(base: str) -> str:
    """CTEs over base(id, t, name) that end in ident(id, kinds): what stands before and after each noun decides."""
    verbs, ends, own = "|".join(fixed.VERBS), "[.!?;]", "|".join(fixed.OWN)
    nouns = lambda names: "(?i)(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")\b"
    kinds = [(k, False, nouns(v)) for k, v in fixed.IDENTITY.items()] + [(k, True, nouns(v)) for k, v in fixed.OPERATED.items()]
    named = [(k, nouns(v).replace("(?i)", r"(?i)\b")) for k, v in fixed.IDENTITY.items()]
    speaks = f"(regexp_matches(w[-2], '(?i)\\bwe$') or regexp_matches(w[-2], '(^|[^\\w])[A-Z][A-Za-z0-9&''.-]*$') or (lower(w[-2]) in {_in(fixed.OWN)} and regexp_matches(w[-3], '(?i)\\b(our|this|the)$')))"
    return f"""rd as (select id, unnest(list_distinct([t, case when t <> '' then trim(name || ' ' || t) else '' end])) as t from (select id, trim(regexp_replace(t, '\\s+', ' ', 'g')) as t, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name from {base})),
      kn as (select rd.id, kind, offered, regexp_split_to_array(t, noun) as p from rd, (values {", ".join(f"({q(k)}, {o}, {q(n)})" for k, o, n in kinds)}) ks(kind, offered, noun) where regexp_matches(t, noun)),
      ht as (select id, kind, offered, unnest(range(1, len(p))) as i, p from kn),
      ld as (select id, kind, offered, case when i = 1 then '' else 'x' end as head, p[i] as b, p[i + 1] as a, i + 1 = len(p) as final from ht),
      vs as (select id, kind, offered, head, a, final, unnest(case when kind = 'news/media' then [b, regexp_replace(b, '[A-Za-z0-9&''.-]+ $', ''), regexp_replace(b, '(?:[A-Za-z0-9&''.-]+ ){{2}}$', ''), regexp_replace(b, '(?:[A-Za-z0-9&''.-]+ ){{3}}$', '')] else [b] end) as b from ld),
      ws as (select *, string_split(rtrim(regexp_replace(b, '(?i)(^| )an? $', '\\1')), ' ') as w, head || regexp_replace(b, '(?i)(^| )an? $', '\\1') as lead from vs),
      ok as (select id, kind from ws where
        (ends_with(b, ' ') and lower(w[-1]) in {_in(fixed.VERBS)} and {speaks})
        or regexp_matches(lead, '(?i)[a-z0-9&''.-] (?:{verbs}) [^.!?;]{{1,160}} as $')
        or (not offered and ends_with(b, ' ') and lower(w[-1]) = 'is' and regexp_matches(w[-2], '(^|[^\\w])[A-Z][A-Za-z0-9&''.-]*$'))
        or (not offered and regexp_matches(lead, '(?i)(?:^|{ends}) ?(?:we are|we''re|(?:our|this|the) (?:{own}) is) $'))
        or (not offered and regexp_matches(lead, '(?i)(?:^|{ends}) ?(?:this )?$') and (final and trim(a) = '' or regexp_matches(lower(a), '^(?: ?[.,;:]| (?:{"|".join(fixed.GOES_ON)}))')))),
      nm as (select id, kind from {base}, (values {", ".join(f"({q(k)}, {q(n)})" for k, n in named)}) ks(kind, noun) where regexp_matches(name, noun)),
      ident as (select id, list(distinct kind) as kinds from (select * from ok union all select * from nm) group by id)"""


_TEXTS = [
    (-1, "We are an industrial sensor controller manufacturer.", ""), (-2, "industrial sensor controller manufacturer", ""), (-3, "A software platform for IoT analytics", ""),
    (-4, "Industrial automation consulting services.", ""), (-5, "travel blog tourism affiliate guide", ""), (-6, "PCB assembly EMS contract manufacturer", ""),
    (-7, "SaaS software platform for industrial automation analytics.", ""), (-8, "Technology news publisher covering sensors and embedded controllers.", ""),
    (-9, "Government-certified medical sensor and controller device manufacturer.", ""), (-10, "We manufacture industrial sensor and controller products and also provide design consulting.", ""),
    (-11, "We design medical sensor devices and provide software services.", ""), (-12, "Our company handles the production of embedded controller devices with a software platform.", ""),
    (-13, "We're a software developer that manufactures industrial sensor controllers.", "Acme Controls"), (-14, "We operate a cloud platform as our business and manufacture industrial sensors.", "Acme Controls"),
    (-15, "Acme Controls is a software vendor and manufactures industrial sensor controllers.", "Acme Controls"), (-16, "We manufacture industrial sensor controllers.", "Acme Software Company"),
    (-17, "We help customers design sensor devices on our cloud platform, industrial and medical.", ""), (-18, "Travel power adapters. We manufacture travel power adapters with embedded controllers and sensors.", ""),
]
_LOW, _EVIDENCE = "lower(t)", "case when {like} then '' else lower(t) end"
_LIKE = r"len(string_split(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), ' ')) between 2 and 6 and not regexp_matches(t, '[.!?,;:]')"
_SERVICES = rf"regexp_replace(regexp_replace(replace(evidence, '#', '-'), {q(prospects._THIRD)}, 'x9x', 'g'), {q(prospects._SERVICE)}, '#', 'g')"


@query(f"""with d as (select doc_id, coalesce(text, '') as t, '' as name from documents union all {_values(_TEXTS).replace("values", "select * from (values", 1)})),
    bs as (select doc_id as id, t, name from d), {_identities_sql("bs")},
    e as (select doc_id, t, name, {_EVIDENCE.format(like=_LIKE)} as evidence, coalesce(kinds, []) as kinds from d left join ident on ident.id = doc_id),
    s as (select doc_id, {_hits("evidence", {k: prospects.term_pattern(v) for k, v in fixed.SIGNALS.items()})} as signals,
        list_distinct(list_concat(list_concat({_hits("lower(t)", {k: prospects.term_pattern(v) for k, v in fixed.EXCLUSIONS.items()})}, kinds),
          case when regexp_matches({_SERVICES}, {q(prospects.physical_pattern())}) then []::varchar[] else {_hits("lower(t)", {k: prospects.term_pattern(v) for k, v in fixed.CONDITIONAL.items()})} end)) as excluded from e)
    select doc_id, len(signals) >= 2 and len(list_filter(signals, lambda x: x not in {_in(fixed.BROAD)})) > 0 and len(excluded) = 0 as eligible,
      array_to_string(signals, ',') as signals, array_to_string(list_sort(excluded), ',') as exclusions from s""")
def hardware_rules(spark, sf_dir):
    """Qualification of each document: signals, exclusions by terms and identity, first-party context."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("name"))
    d = d.unionByName(spark.createDataFrame(_TEXTS, "doc_id long, text string, name string"))
    r = d.select("doc_id", evidence.qualification(F.array("text"), F.col("name")).alias("r"))
    return r.select("doc_id", "r.eligible", F.array_join("r.signals", ",").alias("signals"), F.array_join(F.array_sort("r.exclusions"), ",").alias("exclusions"))


def _initcap(x: str) -> str:
    return f"trim(array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '))"


_SITES = [(-1, "https://acme-controls.de/contact", "<title>Contact - Acme</title>Official company contact page."), (-2, "https://globalgrasshopper.com/legal", "<title>Legal</title><p>travel blog tourism affiliate</p>"), (-3, "https://acme-sensors.co.uk", "<h1>Imprint</h1>Impressum: ACME Sensors GmbH, Berlin, Germany"), (-4, "https://shop.acme-power.com.au/x", "We manufacture travel power adapters with embedded controllers.")]
_PAGES_SQL = f"select page_id, url, coalesce(html, '') as html from pages union all select * from ({_values(_SITES)})"
_TITLE_SQL = rf"coalesce(nullif({_CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), nullif({_CLEAN.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), '')"
_SEPARATORS = (" - ", " | ", " – ", " — ")


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.unionByName(spark.createDataFrame(_SITES, "page_id long, url string, html string"))


@query(rf"""with p as ({_PAGES_SQL}), t as (select page_id, {_TITLE_SQL} as title, {host_sql("url")} as host, {_visible("html")} as t from p),
    n as (select *, trim(regexp_replace(regexp_replace(regexp_extract(t, {q("(?i)" + fixed.LEGAL_NAME)}, 1), '\s+', ' ', 'g'), '^[ ,;:]+|[ ,;:]+$', '', 'g')) as legal, string_split(host, '.') as l,
      case when title = '' then '' when contains(title, ' - ') then split_part(title, ' - ', 1) when contains(title, ' | ') then split_part(title, ' | ', 1) when contains(title, ' – ') then split_part(title, ' – ', 1) when contains(title, ' — ') then split_part(title, ' — ', 1) else title end as title_name from t),
    h as (select *, case when len(l) < 2 then '' else {_initcap(f"regexp_replace(case when len(l) >= 3 and array_to_string(list_slice(l, -2, -1), '.') in {_in(fixed.TWO_LEVEL)} then l[-3] else l[-2] end, '[-_]+', ' ', 'g')")} end as stem from n),
    c as (select page_id, title_name, t, coalesce(nullif(legal, ''), nullif(stem, ''), '') as found, legal from h),
    bs as (select page_id as id, t, '' as name from c union all select page_id, '', found from c), {_identities_sql("bs")}
    select page_id, title_name, case when list_contains(coalesce(kinds, []), 'travel/tourism') then '' else found end as name, legal,
      regexp_replace(regexp_replace(lower(found), '[^\pL\pN_\s]+', ' ', 'g'), '\s+', ' ', 'g') in {_in(fixed.GENERIC_NAMES)} as generic from c left join ident on ident.id = page_id""")
def company_names(spark, sf_dir):
    """The company name of each page: legal name, host, with travel identities refused; the title's part before a separator."""
    title = F.col("title")
    # The separators are tried in their order, whatever comes first in the title.
    first = F.coalesce(*(F.when(title.contains(sep), F.split_part(title, F.lit(sep), F.lit(1))) for sep in _SEPARATORS), title)
    p = _pages(spark, sf_dir).select("page_id", "url", markup.read(F.col("html")).alias("p")).select("page_id", "url", F.col("p.title").alias("title"), F.col("p.text").alias("t"))
    p = p.select("page_id", "url", first.alias("title_name"), "t")
    found = F.coalesce(F.nullif(evidence.legal_name(F.col("t")), F.lit("")), F.nullif(prospects.host_name(F.col("url")), F.lit("")), F.lit(""))
    return p.select("page_id", "title_name", prospects.company_name(F.col("url"), F.col("t"), F.lit("")).alias("name"), evidence.legal_name(F.col("t")).alias("legal"), prospects.generic_name(found).alias("generic"))


# The look-arounds of the pattern, spelt with characters that are matched: every sign is doubled first, so that neighbours don't share one.
_RE2_EMAIL = r"(?i)(?:^|[^\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?:$|[^\w+-])"
_MAILS = [(-1, "Info@Acme.example, jobs@acme.example; john.smith@acme.example"), (-2, "x <sales@gmx.de> bob@gmx.com a@b.png noreply@mg.wixpress.com"), (-3, "email@example.com a%b@c.example anna+x@c.example max9@c.example"), (-4, "hr+de@c.example support+x@aol.com averylonglocalpart@c.example")]


def _mails_sql(source: str) -> str:
    found = rf"unnest(regexp_extract_all(regexp_replace(t, '([^A-Za-z0-9_.%+@-])', '\1\1', 'g'), {q(_RE2_EMAIL)}, 1))"
    clean = r"lower(regexp_replace(raw, '^[.,;:()\[\]{}<>]+|[.,;:()\[\]{}<>]+$', '', 'g'))"
    valid = f"e not in {_in(fixed.PLACEHOLDERS)} and local <> '' and contains(domain, '.') and not regexp_matches(domain, {q('(?:^|[.])(?:' + '|'.join(fixed.NO_CONTACT).replace('.', '[.]') + ')$')}) and split_part(domain, '.', -1) not in {_in(fixed.RESOURCES)} and not regexp_matches(e, '[/\\\\?#%]') and length(local) <= 64 and length(domain) <= 253"
    kind = f"case when domain in {_in(fixed.FREE)} and prefix in {_in(fixed.ROLES)} then 'Generic Company Email' when domain in {_in(fixed.FREE)} then 'Private Email' when prefix in {_in(fixed.NOISY)} then null when prefix in {_in(fixed.ROLES)} then 'Generic Company Email' else 'Public Work Email' end"
    public = f"case when domain in {_in(fixed.FREE)} then true when prefix in {_in(fixed.NOISY)} then false when prefix in {_in(fixed.ROLES)} then true when contains(prefix, '.') then false else length(prefix) <= 12 and not regexp_matches(prefix, '[0-9]') end"
    return f"""f as (select id, {found} as raw from ({source})), m as (select distinct id, {clean} as e from f),
      p as (select id, e, split_part(e, '@', 1) as local, split_part(e, '@', -1) as domain, split_part(split_part(e, '@', 1), '+', 1) as prefix from m),
      typed as (select id, e, domain, {kind} as email_type, {public} as public_business from p where {valid})"""


@query(f"with {_mails_sql(f'select doc_id as id, text as t from documents union all select * from ({_values(_MAILS)})')} select id as doc_id, e as email, email_type, public_business from typed")
def contact_types(spark, sf_dir):
    """Each valid address of each document, its type by noisy, role and free lists, and whether it is a business's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_MAILS, "doc_id long, text string"))
    e = d.select("doc_id", F.explode(F.filter(prospects.addresses(F.col("text")), prospects.valid_email)).alias("email"))
    return e.select("doc_id", "email", prospects.email_type(F.col("email")).alias("email_type"), prospects.public_business(F.col("email")).alias("public_business"))


_LINKS = [
    (-1, "https://a.example/x/y", "<a class=b href='/kontakt'>Kontakt</a> <a href=https://www.linkedin.com/company/a>in</a><A HREF=\"legal\"> Legal <b>notice</b></A> info@a.example boss@other.example"),
    (-2, "https://b.example/", '<a href="/datenschutz">Datenschutz</a><a href="team.html">Team</a><a href="//c.example/jobs">Open jobs</a><a href="/request-form">Ask</a>'),
    (-3, "https://c.example/", "<a href='/enquiry?x=1'>Write</a> no address"), (-4, "https://d.example/", "nothing <a name=x>top</a> <a href='/privacy'>Privacy <i>policy</i>"),
    (-20, "https://www.kompass.com/c/1", "<a href='https://www.facebook.com/x'>Website</a><a href=\"https://one.example/a\">One</a><a href=https://two.example/b>Company Website</a>"), (-21, "https://www.europages.com/d", '<a href="/home">Homepage</a>'),
]
# The SQL's own reading of an anchor, which suffices for these tables: an href in any quotes, a label to the next anchor or its end.
_ANCHOR_SQL = r"""(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)[^<>]*>([^<]*(?:<(?:[^/a<]|/[^a<])[^<]*){0,64})"""


def _anchors_sql() -> str:
    href = "regexp_replace(a[1], '^[\"'']|[\"'']$', '', 'g')"
    return rf"""pg as (select page_id, url, coalesce(html, '') as html from pages union all select * from ({_values(_LINKS)})),
      x as (select page_id, url, generate_subscripts(regexp_extract_all(html, {q(_ANCHOR_SQL)}, 1), 1) as pos, unnest(regexp_extract_all(html, {q(_ANCHOR_SQL)}, 1)) as raw, unnest(regexp_extract_all(html, {q(_ANCHOR_SQL)}, 2)) as rawlabel from pg),
      y as (select page_id, url, pos, {href.replace("a[1]", "raw")} as h, trim(lower(regexp_replace(regexp_replace(rawlabel, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as label from x),
      z as (select page_id, pos, label, case when regexp_matches(h, '^[a-z]+:') then h when starts_with(h, '//') then regexp_extract(url, '^([a-z]+:)', 1) || h when starts_with(h, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h else regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || h end as href from y)"""


def _any(column: str, terms) -> str:
    return "(" + " or ".join(f"contains({column}, {q(t)})" for t in terms) + ")"


_FORM_SQL = f"{_any('label', fixed.FORM_LABELS)} or {_any('lower(href)', fixed.FORM_HREFS)}"


def _linked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(_LINKS, "page_id long, url string, html string"))
    return p.withColumn("anchors", prospects.anchors(F.col("html"), F.col("url")))


@query(f"""with {_anchors_sql()} select pg.page_id, arg_min(href, pos) filter (contains(lower(href), 'linkedin.com/company')) as linkedin, {", ".join(f"arg_min(href, pos) filter ({_any('label', t)}) as {c}" for c, t in fixed.LINK_CLASSES.items())},
    coalesce(arg_min(href, pos) filter ({_FORM_SQL}), '') as form_url, count(href) as n_anchors from pg left join z on z.page_id = pg.page_id group by 1""")
def link_classes(spark, sf_dir):
    """The first anchor of each class and the contact form's URL, hrefs in any quotes or none."""
    a = F.col("anchors")
    return _linked(spark, sf_dir).select("page_id", *(prospects.link_class(a, c).alias(c) for c in ("linkedin", *fixed.LINK_CLASSES)), prospects.form_url(a).alias("form_url"), _long(F.size(a)).alias("n_anchors"))


@query(f"""with {_mails_sql(f'select page_id as id, html as t from pages union all select page_id, html from (select * from ({_values(_LINKS)}) v(page_id, url, html))')}, {_anchors_sql()},
    u as (select page_id, {host_sql("url")} as host from pg), fo as (select page_id, arg_min(href, pos) as form_url from z where {_FORM_SQL} group by 1),
    t as (select id, e, domain, email_type, case email_type when 'Generic Company Email' then 1 when 'Public Work Email' then 2 else 3 end as pr from typed where email_type is not null),
    b as (select id, e, email_type, count(*) over (partition by id) as n from t qualify row_number() over (partition by id order by pr, e) = 1),
    o as (select t.id, arg_min(e, pr || e) as own from t join u on u.page_id = t.id where domain not in {_in(fixed.FREE)} and {attributable_sql("domain", "host")} group by 1)
    select u.page_id, coalesce(b.e, 'Not Found') as email, coalesce(b.email_type, case when form_url is null then 'Not Found' else 'Contact Form Only' end) as email_type, case when b.e is null then coalesce(form_url, '') else '' end as form_url, coalesce(n, 1) as n_candidates, own as attributable_email
    from u left join b on b.id = u.page_id left join fo on fo.page_id = u.page_id left join o on o.id = u.page_id""")
def contact_candidates(spark, sf_dir):
    """Each page's contacts: addresses by type, else the form, else a not-found row; and the first that belongs to the page's company."""
    p = _linked(spark, sf_dir).select("page_id", hosts.host(F.col("url")).alias("host"), prospects.contacts(F.col("html"), prospects.form_url(F.col("anchors"))).alias("c"))
    own = F.filter("c", lambda x: (x["email"] != "Not Found") & ~prospects.email_domain(x["email"]).isin(*fixed.FREE) & hosts.attributable(prospects.email_domain(x["email"]), F.col("host")))
    first = F.col("c")[0]
    return p.select("page_id", first["email"].alias("email"), first["email_type"].alias("email_type"), first["form_url"].alias("form_url"), _long(F.size("c")).alias("n_candidates"), F.try_element_at(own, F.lit(1))["email"].alias("attributable_email"))


# Drafts made of customers: every rule has rows that break it.
_ANGLES = (
    "Hardware signals: electronics, embedded. Fine", "Hardware signals: sensor. We are a cloud provider.", "Hardware signals: industrial, automation.", "hardware signal: sensor controller", "Nothing recorded",
    "Hardware signals: sensor, industrial. Later, hardware signals: motor, camera", "Hardware signals: embedded, sensor. Acme is a travel blog covering tools", "Hardware signals: battery, motor. Some seo services too", "Hardware signals: power, robotics.\nConsulting services",
)
_NAMES = {0: "Contact", 1: "Sensor Companies List", 2: "Unknown", 3: "Acme Software Company"}
_DRAFTS_SQL = f"""dr as (select c_custkey as id, case c_custkey % 7 {" ".join(f"when {k} then {q(n)}" for k, n in _NAMES.items())} else c_name end as company,
      case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then 'wiki' || c_custkey || '.example' else 'cust' || c_custkey || '.example' end as domain,
      case when c_custkey % 5 = 0 then 'bob@gmx.com' when c_custkey % 9 = 0 then 'Not Found' when c_custkey % 17 = 0 then 'bad..mail@x' else 'info@cust' || c_custkey || '.example' end as email,
      case when c_custkey % 6 = 0 then 'Private Email' else 'Generic Company Email' end as email_type,
      case when c_custkey % 8 = 0 then 'https://kompass.com/c/' || c_custkey when c_custkey % 10 = 0 then '' else 'https://www.cust' || c_custkey || '.example/contact; https://kompass.com/x' end as source,
      case when c_custkey % 12 = 0 then '' else 'Public source' end as compliance, case when c_custkey % 15 = 0 then 'FAILED' else '' end as status, case when c_custkey % 14 = 0 then 'YES' else '' end as dnc,
      case when c_custkey % 16 = 0 then '' else 'Subject' end as subject, [{", ".join(map(q, _ANGLES))}][c_custkey % {len(_ANGLES)} + 1] as angle,
      repeat('word ', case when c_custkey % 3 = 0 then 200 else 100 end::int) || case when c_custkey % 4 = 0 then '' else {q(fixed.OPT_OUT)} end as body from customer)"""


def _drafts(spark, sf_dir):
    k = F.col("c_custkey")
    on = lambda m, yes, no: F.when(k % m == 0, yes).otherwise(no)
    cust = F.concat(F.lit("cust"), k.cast("string"), F.lit(".example"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.coalesce(*(F.when(k % 7 == m, n) for m, n in _NAMES.items()), F.col("c_name")).alias("company"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, F.concat(F.lit("wiki"), k.cast("string"), F.lit(".example"))).otherwise(cust).alias("domain"),
        F.when(k % 5 == 0, "bob@gmx.com").when(k % 9 == 0, "Not Found").when(k % 17 == 0, "bad..mail@x").otherwise(F.concat(F.lit("info@"), cust)).alias("email"),
        on(6, "Private Email", "Generic Company Email").alias("email_type"),
        F.when(k % 8 == 0, F.concat(F.lit("https://kompass.com/c/"), k.cast("string"))).when(k % 10 == 0, "").otherwise(F.concat(F.lit("https://www."), cust, F.lit("/contact; https://kompass.com/x"))).alias("source"),
        on(12, "", "Public source").alias("compliance"), on(15, "FAILED", "").alias("status"), on(14, "YES", "").alias("dnc"), on(16, "", "Subject").alias("subject"),
        F.element_at(F.array(*map(F.lit, _ANGLES)), (k % len(_ANGLES) + 1).cast("int")).alias("angle"),
        F.concat(F.repeat(F.lit("word "), on(3, 200, 100)), on(4, "", fixed.OPT_OUT)).alias("body"),
    )


_MAILBOX_SQL = r"case when regexp_matches(email, '^[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$') then split_part(lower(email), '@', -1) else '' end"
# A log of sendings made of orders: not all went out, some have no domain, some a free one.
_LOG_SQL = """lg as (select 'info@cust' || o_custkey || '.example' as email, 'Customer#' || lpad(o_custkey::varchar, 9, '0') as company, case o_orderstatus when 'F' then 'SENT' when 'P' then 'sent' else 'FAILED' end as status,
      case o_orderkey % 4 when 0 then 'cust' || o_custkey || '.example' when 1 then '' when 2 then 'gmx.com' else 'https://www.cust' || o_custkey || '.example/' end as domain,
      case o_orderkey % 3 when 0 then 'https://shop.cust' || o_custkey || '.example/contact' when 1 then 'https://kompass.com/x' else '' end as source, o_orderdate as sent_on from orders where o_totalprice > 300000),
    sent as (select distinct lower(trim(email)) as email from lg where upper(status) = 'SENT'), sentco as (select distinct lower(trim(company)) as company from lg where upper(status) = 'SENT')"""
_SENT_SQL = _LOG_SQL
_RECORDED = r"(?i)\bhardware signals?\s*:\s*([^.\n]+)"


def _list_like(x: str) -> str:
    """Of a list of texts those that are more than a search query, as one."""
    return rf"lower(array_to_string(list_filter({x}, lambda t: t <> '' and not (len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) between 2 and 6 and not regexp_matches(t, '[.!?,;:]'))), ' '))"


def _ordered(found: str, order) -> str:
    return f"list_filter([{', '.join(map(q, order))}], lambda x: list_contains({found}, x))"


_SIGNAL_SQL = _hits(_list_like(f"regexp_extract_all(angle, {q(_RECORDED)}, 1)"), {k: prospects.term_pattern(v) for k, v in fixed.SIGNALS.items()})
_EXCLUDED_SQL = f"""xb as (select id, angle as t, '' as name from dr union all select id, source, '' from dr union all select id, trim(angle || ' ' || source), company from dr), {_identities_sql("xb")},
    xe as (select dr.id, lower(angle || ' ' || source) as every, {_list_like("[angle, source]")} as evidence, coalesce(kinds, []) as kinds, {_SIGNAL_SQL} as signals from dr left join ident on ident.id = dr.id),
    xs as (select id, signals, {_hits("array_to_string(signals, ' ')", {k: prospects.term_pattern(v) for k, v in fixed.SIGNALS.items()})} as again, list_concat({_hits("every", {k: prospects.term_pattern(v) for k, v in fixed.EXCLUSIONS.items()})}, {_ordered("kinds", fixed.IDENTITY)}) as firm,
      case when regexp_matches({_SERVICES}, {q(prospects.physical_pattern())}) then []::varchar[] else {_hits("every", {k: prospects.term_pattern(v) for k, v in fixed.CONDITIONAL.items()})} end as soft from xe),
    xc as (select id, len(signals) as n_signals, len(again) >= 2 and len(list_filter(again, lambda x: x not in {_in(fixed.BROAD)})) > 0 as hardware, list_concat(firm, list_filter(soft, lambda x: not list_contains(firm, x))) as excluded from xs)"""
_RULED_SQL = rf"""{_DRAFTS_SQL}, {_SENT_SQL}, {_EXCLUDED_SQL}, du as (select *, regexp_replace(domain, '^www\.', '') as host0, {_MAILBOX_SQL} as mail_host,
      list_transform(regexp_extract_all(source, '(?i)https?://[^\s;]+'), lambda u: regexp_replace(u, '[.,:)\]}}]+$', '')) as urls from dr),
    dh as (select *, list_transform(urls, lambda u: {host_sql("u")}) as hosts from du),
    dg as (select *, case when host0 = '' then coalesce(list_filter(hosts, lambda h: h <> '')[1], '') else host0 end as host, list_filter(hosts, lambda h: not ({domain_sql("h")}) in {_in(fixed.DIRECTORIES)}) as own,
      len(string_split_regex(trim(replace(body, '/', ' ')), '\s+')) as words, lower(email) in (select email from sent) as was_sent, lower(company) in (select company from sentco) as co_sent, n_signals, hardware, excluded from dh join xc using (id)),
    fs as (select *, list_filter([case when host = '' then 'Company Website/domain missing or invalid' end,
      case when mail_host = '' or mail_host in {_in(fixed.FREE)} then 'Company email domain missing or free mailbox' when host = '' or not {attributable_sql("mail_host", "host")} then 'Email domain does not match company website' end,
      case when len(urls) = 0 then 'Source URL missing or invalid' end, case when host in {_in(fixed.BLOCKED_HOSTS)} or starts_with(host, 'wiki') or contains(host, '.wiki') then 'Blocked encyclopedia/wiki company domain' end,
      case when len(list_filter(hosts, lambda h: h in {_in(fixed.BLOCKED_HOSTS)} or starts_with(h, 'wiki') or contains(h, '.wiki'))) > 0 then 'Blocked encyclopedia/wiki source' end,
      case when {_any("lower(source)", fixed.BLOCKED_SOURCES)} then 'Blocked directory, list, public-sector, blog, media, or service source' end,
      case when lower(company) in {_in(fixed.BLOCKED_NAMES + fixed.GENERIC_NAMES)} then 'Company name is generic or page-title derived' end,
      case when regexp_matches(company, {q(fixed.PAGE_TITLE)}) then 'Company name appears to be a page title or sentence, not a legal company identity' end,
      case when len(hosts) > 0 and host <> '' and len(list_filter(hosts, lambda h: {attributable_sql("h", "host")})) = 0 then 'Source URL is not an attributable company official page' end], lambda x: x is not null) as final from dg),
    fr as (select *, list_filter([case when email in ('', 'Not Found') then 'Email missing' end, case when email not in ('', 'Not Found') and mail_host = '' then 'Invalid email format' end,
      case when email_type not in {_in(fixed.ALLOWED_TYPES)} then 'Email Type not allowed: ' || coalesce(nullif(email_type, ''), 'blank') end,
      case when mail_host in {_in(fixed.FREE)} then 'Free email domain not allowed' when email not in ('', 'Not Found') and not (mail_host <> '' and len(list_filter(case when host0 <> '' then list_concat([host0], list_filter(own, lambda h: {attributable_sql("h", "host0")})) else own end, lambda h: {attributable_sql("mail_host", "h")})) > 0) then 'Recipient domain not attributable to company domain or official source URL' end,
      case when source = '' then 'Source URL missing' end, case when compliance = '' then 'Compliance Note missing' end, case when dnc = 'YES' then 'Do Not Contact' end, case when status <> '' then 'Send Status is ' || status end,
      case when was_sent then 'Email already sent' end, case when co_sent then 'Company already sent' end, case when lower(company) in {_in(fixed.UNRESOLVED + fixed.GENERIC_NAMES)} then 'Company name unresolved or generic' end,
      case when len(urls) > 0 and len(own) = 0 then 'Source is a directory operator' end,
      case when len(excluded) > 0 then 'Excluded prospect type: ' || array_to_string(excluded, ', ') end,
      case when not hardware then 'Hardware qualification failed' end, case when n_signals < 2 then 'Fewer than two recorded hardware signals' end,
      case when not contains(body, {q(fixed.OPT_OUT)}) then 'Opt-out sentence missing' end, case when subject = '' then 'Subject missing' end, case when body = '' then 'Email Body missing' end,
      case when words < 120 or words > 180 then 'Word count out of range: ' || words end, case when {_any("lower(company || ' ' || angle || ' ' || body)", fixed.PEERS)} then 'Possible PCB/PCBA peer' end,
      case when len(final) > 0 then array_to_string(final, '; ') end], lambda x: x is not null) as reasons from fs)"""


def _sent_log(spark, sf_dir):
    """The rows of _LOG_SQL."""
    c = F.col
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    cust, key = F.concat(F.lit("cust"), c("o_custkey").cast("string"), F.lit(".example")), c("o_orderkey")
    return o.select(
        F.concat(F.lit("info@"), cust).alias("email"), F.concat(F.lit("Customer#"), F.lpad(c("o_custkey").cast("string"), 9, "0")).alias("company"),
        F.when(c("o_orderstatus") == "F", "SENT").when(c("o_orderstatus") == "P", "sent").otherwise("FAILED").alias("status"),
        F.when(key % 4 == 0, cust).when(key % 4 == 1, "").when(key % 4 == 2, "gmx.com").otherwise(F.concat(F.lit("https://www."), cust, F.lit("/"))).alias("domain"),
        F.when(key % 3 == 0, F.concat(F.lit("https://shop."), cust, F.lit("/contact"))).when(key % 3 == 1, "https://kompass.com/x").otherwise("").alias("source"), c("o_orderdate").alias("sent_on"),
    )


def _sent(log, column):
    return log.where(F.upper("status") == "SENT").select(F.lower(F.trim(column)).alias(column)).distinct()


def _ruled(spark, sf_dir):
    d, log, c = _drafts(spark, sf_dir), _sent_log(spark, sf_dir), F.col
    d = d.withColumn("low_email", F.lower("email")).withColumn("low", F.lower("company"))
    d = d.join(_sent(log, "email").toDF("low_email").withColumn("was_sent", F.lit(True)), "low_email", "left").join(_sent(log, "company").toDF("low").withColumn("co_sent", F.lit(True)), "low", "left")
    # What comes out of the Arrow functions is computed once, whatever later refers to it.
    d = d.withColumn("urls", sites.of(c("source"))).withColumn("site", F.get(sites.of(F.concat(F.lit("https://"), c("domain"))), F.lit(0)))
    d = d.withColumn("mail", hosts.mailbox(c("email"))).withColumn("mail_site", F.get(sites.of(F.concat(F.lit("https://"), hosts.mailbox_domain(c("mail")))), F.lit(0)))
    d = d.withColumn("told", evidence.draft(F.regexp_extract_all("angle", F.lit(_RECORDED), F.lit(1)), F.array("angle", "source"), c("company")))
    d = d.withColumn("signals", c("told.signals")).withColumn("hardware", c("told.hardware")).withColumn("excluded", c("told.exclusions"))
    own, mail_host, mail_domain = F.coalesce(c("site.host"), F.lit("")), F.coalesce(c("mail_site.host"), F.lit("")), F.coalesce(c("mail_site.domain"), F.lit(""))
    first = F.try_element_at(F.filter("urls", lambda u: u["host"] != ""), F.lit(1))
    host = F.when(own == "", F.coalesce(first["host"], F.lit(""))).otherwise(own)
    host_domain = F.when(own == "", F.coalesce(first["domain"], F.lit(""))).otherwise(c("site.domain"))
    wiki = lambda h: h.isin(*fixed.BLOCKED_HOSTS) | h.startswith("wiki") | h.contains(".wiki")
    when = lambda *rules: F.array_compact(F.array(*(F.when(cond, reason if isinstance(reason, Column) else F.lit(reason)) for cond, reason in rules)))
    free_mail = (mail_host == "") | mail_host.isin(*fixed.FREE)
    final = when(
        (host == "", "Company Website/domain missing or invalid"), (free_mail, "Company email domain missing or free mailbox"),
        (~free_mail & ((host == "") | ~hosts.same_company(mail_host, mail_domain, host, host_domain)), "Email domain does not match company website"), (F.size("urls") == 0, "Source URL missing or invalid"),
        (wiki(host), "Blocked encyclopedia/wiki company domain"), (F.exists("urls", lambda u: wiki(u["host"])), "Blocked encyclopedia/wiki source"),
        (prospects.contains_any(F.lower("source"), fixed.BLOCKED_SOURCES), "Blocked directory, list, public-sector, blog, media, or service source"),
        (c("low").isin(*fixed.BLOCKED_NAMES) | prospects.generic_name(c("company")), "Company name is generic or page-title derived"),
        (c("company").rlike(fixed.PAGE_TITLE), "Company name appears to be a page title or sentence, not a legal company identity"),
        ((F.size("urls") > 0) & (host != "") & ~F.exists("urls", lambda u: hosts.same_company(u["host"], u["domain"], host, host_domain)), "Source URL is not an attributable company official page"),
    )
    d = d.withColumn("final", final)
    listed = lambda u: prospects.directory(u["domain"])
    able = lambda u: u["host"].contains(".") & ~u["domain"].isin(*fixed.NOT_COMPANIES) & ~listed(u)
    mine = lambda u: hosts.same_company(mail_host, mail_domain, u["host"], u["domain"])
    by_source = F.exists("urls", lambda u: able(u) & mine(u) & ((own == "") | hosts.same_company(u["host"], u["domain"], own, c("site.domain"))))
    attributable = (mail_host != "") & ~mail_host.isin(*fixed.FREE) & (by_source | (own != "") & hosts.same_company(mail_host, mail_domain, own, c("site.domain")))
    given, words = ~c("email").isin("", "Not Found"), F.size(F.split(F.trim(F.replace("body", F.lit("/"), F.lit(" "))), r"\s+"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    reasons = when(
        (~given, "Email missing"), (given & (c("mail") == ""), "Invalid email format"), (~c("email_type").isin(*fixed.ALLOWED_TYPES), F.concat(F.lit("Email Type not allowed: "), F.when(c("email_type") == "", "blank").otherwise(c("email_type")))),
        (mail_host.isin(*fixed.FREE), "Free email domain not allowed"),
        (~mail_host.isin(*fixed.FREE) & given & ~yes(attributable), "Recipient domain not attributable to company domain or official source URL"),
        (c("source") == "", "Source URL missing"), (c("compliance") == "", "Compliance Note missing"), (c("dnc") == "YES", "Do Not Contact"), (c("status") != "", F.concat(F.lit("Send Status is "), c("status"))),
        (yes(c("was_sent")), "Email already sent"), (yes(c("co_sent")), "Company already sent"), (c("low").isin(*fixed.UNRESOLVED) | prospects.generic_name(c("company")), "Company name unresolved or generic"),
        ((F.size("urls") > 0) & F.forall("urls", listed), "Source is a directory operator"),
        (F.size("excluded") > 0, F.concat(F.lit("Excluded prospect type: "), F.array_join("excluded", ", "))), (~c("hardware"), "Hardware qualification failed"), (F.size("signals") < 2, "Fewer than two recorded hardware signals"),
        (~c("body").contains(fixed.OPT_OUT), "Opt-out sentence missing"), (c("subject") == "", "Subject missing"), (c("body") == "", "Email Body missing"),
        (~words.between(120, 180), F.concat(F.lit("Word count out of range: "), words.cast("string"))), (prospects.contains_any(F.lower(F.concat_ws(" ", "company", "angle", "body")), fixed.PEERS), "Possible PCB/PCBA peer"),
        (F.size("final") > 0, F.array_join("final", "; ")),
    )
    return d.withColumn("reasons", reasons)


@query(f"with {_RULED_SQL} select id, len(reasons) = 0 as eligible, array_to_string(reasons, '; ') as reasons, case when len(final) = 0 then 'PASS' else 'BLOCKED' end as safety from fr")
def send_rules(spark, sf_dir):
    """Every reason against sending a draft, in order, and the final safety check."""
    r = _ruled(spark, sf_dir)
    return r.select("id", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", "; ").alias("reasons"), F.when(F.size("final") == 0, "PASS").otherwise("BLOCKED").alias("safety"))


@query(f"with {_RULED_SQL} select coalesce(reasons[1], 'eligible') as reason, count(*) as n, count(*) filter (len(reasons) = 0 and status = '') as pending from fr group by 1")
def unsent_reasons(spark, sf_dir):
    """Drafts by the first reason against them, and those still to send."""
    r = _ruled(spark, sf_dir)
    return r.groupBy(F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.count_if((F.size("reasons") == 0) & (F.col("status") == "")).alias("pending"))


_RESULTS = [(-1, "Top 10 sensor makers", "https://clutch.co/x"), (-2, "Acme IoT cloud platform", "https://acme.example"), (-3, "Liste: Suppliers", "https://www.kompass.com/a"), (-4, "SUPPLIERS", "https://sub.europages.com/b"), (-5, "Sensor & SaaS controller", "https://en.wikipedia.org/wiki/S"), (-6, "Encontrá a tu proveedor", "https://b.example/sensor")]
_QUERY = "Germany industrial sensor manufacturer contact"
_QUERY_TERMS = ("industrial", "sensor")


@query(rf"""with r as (select page_id as id, {_TITLE_SQL} as title, url from pages union all select * from ({_values(_RESULTS)})),
    d as (select id, title, url, lower(title || ' ') as low, {host_sql("url")} as h, trim(lower(translate(title, 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'))) as plain from r),
    e as (select *, {domain_sql("h")} as domain from d)
    select id, ({" + ".join(f"contains(low, {q(t)})::int" for t in fixed.HARDWARE)}) > 0 and (({" + ".join(f"contains(low, {q(t)})::int" for t in fixed.SOFTWARE)}) = 0 or ({" + ".join(f"contains(low, {q(t)})::int" for t in fixed.HARDWARE)}) >= 2) as hardware,
      domain not in {_in(fixed.NOT_COMPANIES)} and plain not in {_in(fixed.LISTING_TITLES)} and not {_any("plain", fixed.LISTINGS)} as company, domain in {_in(fixed.DIRECTORIES)} as directory, domain in {_in(fixed.NOISE_HOSTS)} as noise,
      {_any("lower(title || ' ' || url)", _QUERY_TERMS)} as relevant, {_any("low", fixed.PEERS)} as peer,
      domain <> '' and domain not in {_in(fixed.NOT_COMPANIES)} and domain not in {_in(fixed.DIRECTORIES)} as cacheable from e""")
def result_filters(spark, sf_dir):
    """Each search result by the filters it has to pass: hardware, listing, directory, noise, relevance, peer, cacheable."""
    r = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), html.title(F.col("html")).alias("title"), "url").unionByName(spark.createDataFrame(_RESULTS, "id long, title string, url string"))
    title, domain = F.col("title"), F.col("domain")
    r = r.withColumn("domain", hosts.registrable_domain(hosts.host(F.col("url"))))
    return r.select(
        "id", prospects.hardware_result(title, F.lit("")).alias("hardware"), prospects.company_result(title, domain).alias("company"), prospects.directory(domain).alias("directory"), domain.isin(*fixed.NOISE_HOSTS).alias("noise"),
        prospects.query_relevant(F.lit(_QUERY), F.concat_ws(" ", "title", "url")).alias("relevant"), prospects.contains_any(F.lower(title), fixed.PEERS).alias("peer"),
        ((domain != "") & ~domain.isin(*fixed.NOT_COMPANIES) & ~prospects.directory(domain)).alias("cacheable"),
    )


_WRAPPED = [
    (-1, "https://duckduckgo.com/l/?uddg=https%3A%2F%2Facme.example%2Fa&rut=1"), (-2, "https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9hY21lLmV4YW1wbGUv&n=2"), (-3, "https://r.search.yahoo.com/_ylt=x/RU=https%3a%2f%2fb.example%2f/RK=2/RS=z"),
    (-4, "/url?q=https://c.example/p&sa=U"), (-5, "https://Acme.Example/Path/#top"), (-6, "HTTPS://D.example/Impressum/?A=b#x"), (-7, "https://e.example/catalog.PDF"),
]
_TARGET_SQL = r"""case when contains(url, 'duckduckgo.com/l/') and regexp_extract(url, '[?&]uddg=([^&#]+)', 1) <> '' then url_decode(regexp_extract(url, '[?&]uddg=([^&#]+)', 1))
      when regexp_matches(url, '^https?://(?:www[.])?bing[.]com/ck/') and regexp_matches(url, '[?&]u=a1') then decode(from_base64(rpad(replace(replace(regexp_extract(url, '[?&]u=a1([^&#]+)', 1), '-', '+'), '_', '/'), (ceil(length(regexp_extract(url, '[?&]u=a1([^&#]+)', 1)) / 4.0) * 4)::int, '=')))
      when contains(url, '/RU=') then url_decode(split_part(split_part(url, '/RU=', 2), '/RK=', 1)) when starts_with(url, '/url?') then url_decode(regexp_extract(url, '[?&]q=([^&#]+)', 1)) else url end"""


@query(rf"""with u as (select page_id as id, url from pages union all select * from ({_values(_WRAPPED)})), t as (select id, url, {_TARGET_SQL} as target from u),
    o as (select *, regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin, {host_sql("target")} as host from t)
    select id, target, lower(origin) || regexp_replace(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(target, '([?][^#]*)', 1) as source_key,
      case when contains(lower(target), '.pdf') then 'pdf' when contains(lower(target), 'impressum') or contains(lower(target), 'kontakt') then 'impressum' when contains(lower(target), 'contact') then 'contact' when contains(lower(target), 'legal') then 'legal' else 'official' end as kind,
      origin || '/' || case when id % 2 = 0 then 'impressum' else 'contact' end as contact_url, coalesce(nullif({domain_sql("host")}, ''), host) as domain_key from o""")
def url_rules(spark, sf_dir):
    """Redirects unwrapped, source keys, page kinds, candidate contact pages and domain keys of each URL."""
    u = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(spark.createDataFrame(_WRAPPED, "id long, url string"))
    url, got = F.col("url"), lambda p: F.regexp_extract("url", rf"[?&]{p}([^&#]+)", 1)
    coded = F.translate(got("u=a1"), "-_", "+/")
    target = (
        F.when(url.contains("duckduckgo.com/l/") & (got("uddg=") != ""), F.try_url_decode(got("uddg="))).when(url.rlike(r"^https?://(?:www[.])?bing[.]com/ck/") & url.rlike("[?&]u=a1"), F.decode(F.unbase64(coded), "UTF-8"))
        .when(url.contains("/RU="), F.try_url_decode(F.split_part(F.split_part(url, F.lit("/RU="), F.lit(2)), F.lit("/RK="), F.lit(1)))).when(url.startswith("/url?"), F.try_url_decode(got("q="))).otherwise(url)
    )
    t = u.withColumn("target", target)
    low, origin = F.lower("target"), F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, args = F.regexp_replace(F.regexp_extract("target", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", ""), F.regexp_extract("target", "([?][^#]*)", 1)
    kind = F.when(low.contains(".pdf"), "pdf").when(low.contains("impressum") | low.contains("kontakt"), "impressum").when(low.contains("contact"), "contact").when(low.contains("legal"), "legal").otherwise("official")
    host = hosts.host(F.col("target"))
    paths = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, fixed.GERMAN_PATHS))).otherwise(F.array(*map(F.lit, fixed.OTHER_PATHS)))  # by the country of the page
    return t.select("id", "target", F.concat(F.lower(origin), path, args).alias("source_key"), kind.alias("kind"), F.concat(origin, F.lit("/"), paths[0]).alias("contact_url"), F.coalesce(F.nullif(hosts.registrable_domain(host), F.lit("")), host).alias("domain_key"))


_YIELD = """y as (select user_id, count(*) as searches, count(*) filter (event_type = 'purchase') as emails, count(*) filter (event_type = 'signup') as qualified, count(*) filter (event_type = 'click') as domains, count(*) filter (event_type = 'error') as leads,
      count(*) filter (event_type = 'view' and value > 150) as sent, count(*) filter (event_id > coalesce((select max(e.event_id) from events e where e.user_id = events.user_id and e.event_type = 'purchase'), -1)) >= 3 as paused from events group by user_id)"""


def _yields(spark, sf_dir):
    from recordweave.operators import state

    e, is_ = table(spark, sf_dir, "events"), lambda t: F.col("event_type") == t
    y = e.groupBy("user_id").agg(F.count("*").alias("searches"), F.count_if(is_("purchase")).alias("emails"), F.count_if(is_("signup")).alias("qualified"), F.count_if(is_("click")).alias("domains"), F.count_if(is_("error")).alias("leads"), F.count_if(is_("view") & (F.col("value") > 150)).alias("sent"))
    zeros = state.trailing_zeros(state.zero_runs(e, "user_id", ["event_id"], is_("purchase")), "user_id")
    return y.join(zeros.select("user_id", (F.col("zero_streak") >= 3).alias("paused")), "user_id")


@query(f"""with {_YIELD}, o as (select c_custkey, row_number() over (partition by c_nationkey order by case when paused then 1 else 0 end, case when y.user_id is null then 1 when emails > 0 or qualified > 0 or sent > 0 then 0 else 2 end,
      -(coalesce(emails, 0) / greatest(1, coalesce(searches, 0))), -(coalesce(qualified, 0) / greatest(1, coalesce(searches, 0))), -(coalesce(domains, 0) / greatest(1, coalesce(searches, 0))), c_custkey) as rank from customer left join y on y.user_id = c_custkey)
    select c_custkey, rank from o""")
def keyword_order(spark, sf_dir):
    """Each nation's queries in the order to run: paused last, productive first, untested between, by mail, qualified and domain rates, then as given."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_yields(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left")
    per = lambda x: -(F.coalesce(x, F.lit(0)) / F.greatest(F.lit(1), F.coalesce("searches", F.lit(0))))
    group = F.when(F.col("searches").isNull(), 1).when((F.col("emails") > 0) | (F.col("qualified") > 0) | (F.col("sent") > 0), 0).otherwise(2)
    order = [F.when(F.col("paused"), 1).otherwise(0), group, per("emails"), per("qualified"), per("domains"), F.col("c_custkey")]
    return c.select("c_custkey", _long(F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order))).alias("rank"))


@query(f"""with {_YIELD} select user_id, sent, emails, paused, row_number() over (order by -sent, -(qualified / greatest(1, searches)), -(emails / greatest(1, searches)), -domains, -leads, user_id) as rank from y where not paused qualify rank <= 5""")
def keyword_ranking(spark, sf_dir):
    """The five best queries that aren't paused, by sends, rates, domains, leads and name."""
    y = _yields(spark, sf_dir).where("not paused")
    order = [F.desc("sent"), -(F.col("qualified") / F.greatest(F.lit(1), "searches")), -(F.col("emails") / F.greatest(F.lit(1), "searches")), F.desc("domains"), F.desc("leads"), F.col("user_id")]
    top = y.orderBy(*order).limit(5)
    return top.select("user_id", "sent", "emails", "paused", _long(F.row_number().over(Window.orderBy(*order))).alias("rank"))


@query("""with i as (select n_nationkey, case when n_nationkey % 2 = 0 then 0 else 1 end as tier, row_number() over (partition by case when n_nationkey % 2 = 0 then 0 else 1 end order by n_nationkey) - 1 as pos from nation)
    select r_regionkey as country, n_nationkey as industry, row_number() over (order by tier, r_regionkey + pos, r_regionkey) as rank, (n_nationkey + 1) % 25 as next_industry, (r_regionkey + case when n_nationkey = 24 then 1 else 0 end) % 5 as next_country
    from region, i where not (r_regionkey = 1 and n_nationkey = 2) qualify rank <= 60""")
def fallback_tiers(spark, sf_dir):
    """Country and industry pairs to fall back to, high-yield industries first, along anti-diagonals, the current pair left out; and each pair's successor."""
    tier = F.when(F.col("n_nationkey") % 2 == 0, 0).otherwise(1)
    i = table(spark, sf_dir, "nation").select("n_nationkey", tier.alias("tier")).withColumn("pos", F.row_number().over(Window.partitionBy("tier").orderBy("n_nationkey")) - 1)
    g = i.join(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey")), F.lit(True))  # two dimensions of fixed size: the product is the feature
    order = ["tier", F.col("r_regionkey") + F.col("pos"), "r_regionkey"]
    best = g.where("not (r_regionkey = 1 and n_nationkey = 2)").orderBy(*order).limit(60)
    return best.select(F.col("r_regionkey").alias("country"), F.col("n_nationkey").alias("industry"), _long(F.row_number().over(Window.orderBy(*order))).alias("rank"), _long((F.col("n_nationkey") + 1) % 25).alias("next_industry"), _long((F.col("r_regionkey") + F.when(F.col("n_nationkey") == 24, 1).otherwise(0)) % 5).alias("next_country"))


_JOBS = r"\b(hardware|embedded|electronics|firmware) engineer\b"
_LABELS = [(-1, "We hire an Embedded Engineer for robot arms"), (-2, "RFQ for sensor boards, supplier wanted"), (-3, "PCBA for medical device"), (-4, "IoT gateway"), (-5, "home automation")]


@query(f"""with t as (select doc_id, lower(coalesce(text, '')) as l from documents union all select doc_id, lower(t) from (select * from ({_values(_LABELS)}) v(doc_id, t)))
    select doc_id, case when contains(l, 'robot') then 'Robotics' when contains(l, 'medical device') or contains(l, 'healthcare') then 'Medical Device' when contains(l, 'sensor') then 'Sensor / Instrumentation' when contains(l, 'automation') or contains(l, 'industrial control') then 'Industrial Automation' when contains(l, 'iot') or contains(l, 'embedded') then 'IoT / Embedded System' else 'Unknown' end as industry,
      case when regexp_matches(l, {q(_JOBS)}) then 'hiring' when {_any("l", ("procurement", "supplier", "tender", "rfq"))} then 'procurement' when {_any("l", ("pcb", "pcba", "smt", "control board"))} then 'board' else 'product' end as demand,
      case when {_any("l", fixed.HARDWARE)} and {_any("l", ("engineer", "supplier", "procurement", "pcba"))} then 5 when {_any("l", fixed.HARDWARE)} then 4 when {_any("l", ("automation", "iot", "robotics"))} then 3 when contains(l, '@') then 2 else 1 end as score from t""")
def text_labels(spark, sf_dir):
    """Industry, demand signal and ordinal score of each text, the first rule that holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_LABELS, "doc_id long, text string"))
    d = d.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("l"))
    has = lambda *terms: prospects.contains_any(F.col("l"), terms)
    industry = F.when(has("robot"), "Robotics").when(has("medical device", "healthcare"), "Medical Device").when(has("sensor"), "Sensor / Instrumentation").when(has("automation", "industrial control"), "Industrial Automation").when(has("iot", "embedded"), "IoT / Embedded System").otherwise("Unknown")
    demand = F.when(F.col("l").rlike(_JOBS), "hiring").when(has("procurement", "supplier", "tender", "rfq"), "procurement").when(has("pcb", "pcba", "smt", "control board"), "board").otherwise("product")
    score = F.when(has(*fixed.HARDWARE) & has("engineer", "supplier", "procurement", "pcba"), 5).when(has(*fixed.HARDWARE), 4).when(has("automation", "iot", "robotics"), 3).when(has("@"), 2).otherwise(1)
    return d.select("doc_id", industry.alias("industry"), demand.alias("demand"), score.alias("score"))


@query(f"""with {_DRAFTS_SQL}, {_SENT_SQL}, l as (select id, company, domain, lower(email) as email, {_MAILBOX_SQL} as mail_host from dr)
    select id, lower(trim(regexp_replace(company, '\\s+', ' ', 'g'))) || '|' || domain as dedupe_key, case when email in ('not found', '') then '' else email end as known_email, email in (select email from sent) as sent,
      case when domain <> '' and domain not in {_in(fixed.FREE)} then domain when domain = '' and mail_host <> '' and mail_host not in {_in(fixed.FREE)} then mail_host else '' end as sent_domain from l""")
def known_keys(spark, sf_dir):
    """What excludes a record later: dedupe key, known address, whether that was sent to, and the domain that a sending counts for."""
    from recordweave.functions import text

    c, d = F.col, _drafts(spark, sf_dir).withColumn("email", F.lower("email"))
    d = d.join(_sent(_sent_log(spark, sf_dir), "email").withColumn("sent", F.lit(True)), "email", "left")
    mail, host = hosts.mailbox_domain(hosts.mailbox(c("email"))), hosts.host(c("domain"))
    to = F.when((host != "") & ~host.isin(*fixed.FREE), host).when((host == "") & (mail != "") & ~mail.isin(*fixed.FREE), mail).otherwise("")
    return d.select("id", text.dedupe_key(c("company"), host).alias("dedupe_key"), F.when(c("email").isin("not found", ""), "").otherwise(c("email")).alias("known_email"), F.coalesce("sent", F.lit(False)).alias("sent"), to.alias("sent_domain"))


def _sent_domains(log):
    """domain of each row that went out: the company's own, or where none is named, the mailbox's if a host of the source has it; null if neither."""
    c, site = F.col, lambda x: F.get(sites.of(F.concat(F.lit("https://"), x)), F.lit(0))
    gone = log.where(F.upper("status") == "SENT").withColumn("s", site(F.regexp_replace("domain", "^https://", ""))).withColumn("urls", sites.of(c("source")))
    gone = gone.withColumn("m", site(hosts.mailbox_domain(hosts.mailbox(c("email")))))
    own = lambda u: (u["host"] != "") & ~u["domain"].isin(*fixed.NOT_COMPANIES) & ~prospects.directory(u["domain"]) & hosts.same_company(c("m.host"), c("m.domain"), u["host"], u["domain"])
    to = F.when((c("s.domain") != "") & ~c("s.host").isin(*fixed.FREE), c("s.host")).when((F.trim("domain") == "") & ~c("m.host").isin(*fixed.FREE) & F.exists("urls", own), c("m.host"))
    return gone.select(to.alias("domain"))


_SENT_DOMAINS_SQL = f"""lx as (select *, {host_sql("domain")} as h, list_transform(regexp_extract_all(source, '(?i)https?://[^\\s;]+'), lambda u: {host_sql("u")}) as hs, {_MAILBOX_SQL} as mail_host from lg where upper(status) = 'SENT'),
    ly as (select case when h <> '' and {domain_sql("h")} <> '' and h not in {_in(fixed.FREE)} then h
      when trim(domain) = '' and mail_host <> '' and mail_host not in {_in(fixed.FREE)} and len(list_filter(hs, lambda x: x <> '' and ({domain_sql("x")}) not in {_in(fixed.NOT_COMPANIES + fixed.DIRECTORIES)} and {attributable_sql("mail_host", "x")})) > 0 then mail_host else '' end as d from lx)"""
_LEADS_SQL = "ld0 as (select s_suppkey as id, s_name as company, case when s_suppkey % 5 = 0 then '' else 'https://www.supp' || s_suppkey || '.co.uk/x' end as site, case when s_suppkey % 3 = 0 then '未公开/待核实' else 'Sales@supp' || s_suppkey || '.co.uk ' end as email from supplier)"


@query(f"""with {_DRAFTS_SQL}, {_LOG_SQL}, {_LEADS_SQL}, lh as (select *, {host_sql("site")} as h from ld0),
    {_SENT_DOMAINS_SQL}
    select distinct * from (
      select 'company key' as kind, lower(trim(regexp_replace(company, '\\s+', ' ', 'g'))) || '|' || case when h = '' then '' else {domain_sql("h")} end as value from lh
      union all select 'domain', {domain_sql("h")} from lh where h <> '' union all select 'email', lower(trim(email)) from (select email from ld0 union all select email from dr union all select email from lg)
      union all select 'sent email', email from sent union all select 'sent company', company from sentco union all select 'sent domain', d from ly)
    where value <> '' and not (kind = 'email' and value in ('not found', '未公开/待核实'))""")
def known_sets(spark, sf_dir):
    """What leads, drafts and the log of sendings rule out for new records, as distinct values of each kind.

    A domain counts as sent to where the log names a company's own, or, where it names none,
    the mailbox's if it belongs to a host of the row's source.
    """
    from recordweave.functions import text

    c, log = F.col, _sent_log(spark, sf_dir)
    k = c("s_suppkey")
    leads = table(spark, sf_dir, "supplier").select(c("s_name").alias("company"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://www.supp"), k.cast("string"), F.lit(".co.uk/x"))).alias("site"), F.when(k % 3 == 0, "未公开/待核实").otherwise(F.concat(F.lit("Sales@supp"), k.cast("string"), F.lit(".co.uk "))).alias("email"))
    leads = leads.withColumn("s", F.get(sites.of(c("site")), F.lit(0))).withColumn("domain", F.coalesce("s.domain", F.lit("")))
    values = {
        "company key": leads.select(text.dedupe_key(c("company"), c("domain"))), "domain": leads.select("domain"), "email": leads.select("email").union(_drafts(spark, sf_dir).select("email")).union(log.select("email")).select(F.lower(F.trim("email"))),
        "sent email": _sent(log, "email"), "sent company": _sent(log, "company"), "sent domain": _sent_domains(log),
    }
    all_ = None
    for kind, frame in values.items():
        one = frame.toDF("value").select(F.lit(kind).alias("kind"), "value")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.where((c("value") != "") & ~((c("kind") == "email") & c("value").isin("not found", "未公开/待核实"))).distinct()


@query(f"""with {_DRAFTS_SQL} select id, lower(substr(company || ': ' || subject, 1, 60)) as subject, len(string_split_regex(trim(replace(body, '/', ' ')), '\\s+')) as words, case id % 4 when 0 then 'DE' when 1 then 'GB' when 2 then 'US' else 'US' end as phone_region from dr""")
def draft_texts(spark, sf_dir):
    """Subjects of at most 60 characters, word counts and phone regions of drafts."""
    country = F.when(F.col("id") % 4 == 0, "Germany").when(F.col("id") % 4 == 1, "UK").when(F.col("id") % 4 == 2, "USA").otherwise("Atlantis")
    regions = F.create_map(*(F.lit(x) for pair in fixed.REGIONS.items() for x in pair))
    return _drafts(spark, sf_dir).select("id", F.lower(F.substring(F.concat_ws(": ", "company", "subject"), 1, 60)).alias("subject"), _long(F.size(F.split(F.trim(F.replace("body", F.lit("/"), F.lit(" "))), r"\s+"))).alias("words"), F.coalesce(F.try_element_at(regions, country), F.lit("US")).alias("phone_region"))


_MOST_SENT = 25


@query(f"""with {_RULED_SQL}, {_SENT_DOMAINS_SQL}, el as (select id, lower(email) as email, lower(company) as company, host0 as domain from fr where len(reasons) = 0 and status = '' and len(final) = 0 and host0 not in (select d from ly where d <> '')),
    tw as (select * from el union all select id + 1000000, email, 'twin ' || company, domain from el where id % 2 = 0),
    ft as (select * from tw t where not exists (select 1 from tw e where e.id < t.id and (e.email = t.email or e.company = t.company or e.domain = t.domain))),
    nw as (select 'cust' || o_custkey || '.example' as domain from orders where o_totalprice between 290000 and 300000 and o_orderstatus = 'F'),
    rk as (select id, domain, row_number() over (order by id) as place from ft)
    select id, place, case when domain in (select domain from nw) then 'skipped' else 'to send' end as decision from rk where place <= {_MOST_SENT}""")
def send_selection(spark, sf_dir):
    """The drafts of a run that may go out, in order and up to its limit, and what a second look at the grown log makes of each.

    A draft must be eligible, not handled yet and safe; its domain not sent to before; and
    no draft before it may have its mailbox, company or domain.
    """
    from recordweave.operators import dedupe
    from recordweave.shared import keep

    c, log = F.col, _sent_log(spark, sf_dir)
    d = _ruled(spark, sf_dir).where((F.size("reasons") == 0) & (c("status") == "") & (F.size("final") == 0))
    d = d.select("id", "low_email", "low", F.coalesce("site.host", F.lit("")).alias("host"))
    d = d.join(_sent_domains(log).where("domain is not null").select(c("domain").alias("host")).distinct(), "host", "left_anti").select("id", "low_email", "low", "host")
    d = keep(d)  # few of the drafts, at the end of all rules
    twins = d.where(c("id") % 2 == 0).select((c("id") + 1_000_000).alias("id"), "low_email", F.concat(F.lit("twin "), c("low")).alias("low"), "host")
    picked = dedupe.greedy(d.unionByName(twins), "id", ["low_email", "low", "host"]).orderBy("id").limit(_MOST_SENT)
    placed = picked.withColumn("place", F.row_number().over(Window.orderBy("id")).cast("long"))  # of the run's limit of rows
    grown = table(spark, sf_dir, "orders").where("o_totalprice between 290000 and 300000 and o_orderstatus = 'F'").select(F.concat(F.lit("cust"), c("o_custkey").cast("string"), F.lit(".example")).alias("host")).distinct()
    return placed.join(grown.withColumn("_sent", F.lit(True)), "host", "left").select("id", "place", F.when(c("_sent"), "skipped").otherwise("to send").alias("decision"))
