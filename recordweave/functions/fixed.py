"""Fixed values of the record rules: word lists, patterns and reasons whose wording decides the results."""

from __future__ import annotations

# Mail addresses.
FREE = ("yahoo.com", "googlemail.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "proton.me", "protonmail.com", "gmx.com", "gmx.de")
ROLES = ("sales", "info", "contact", "hello", "office", "support", "business", "purchasing", "procurement", "engineering", "enquiries", "inquiries", "mail", "service")
NOISY = ("jobs", "career", "careers", "hr", "privacy", "legal", "press", "media", "webmaster", "postmaster", "admin")
RESOURCES = ("png", "jpg", "jpeg", "gif", "webp", "svg", "css", "js", "ico", "pdf", "zip")
NO_CONTACT = ("wixpress.com", "sentry.io", "sentry-next.wixpress.com")
PLACEHOLDERS = ("example@domain.com", "email@example.com", "johnsmith@example.com", "name@example.com", "name@example.org", "yourname@example.com")

# Names, signals and exclusions.
GENERIC_NAMES = ("about", "contact", "contact us", "disclaimer", "home", "homepage", "imprint", "impressum", "legal", "legal notice", "legal and affiliate disclaimer", "privacy", "privacy policy", "terms", "terms and conditions")
LEGAL_FORMS = "GmbH|AG|Ltd|Limited|Inc|LLC|BV|AB|Oy|SAS|SA"
LEGAL_NAME = r"\b([A-Za-z0-9][A-Za-z0-9&.'()/ -]{1,80}\s+(?:GmbH|AG|Ltd|Limited|Inc|LLC|BV|AB|Oy|SAS|SA))\b"
TWO_LEVEL = ("co.uk", "com.au", "co.nz", "co.jp", "co.in")
SIGNALS = {
    "industrial": ("industrial",), "sensor": ("sensor", "sensing"), "controller": ("controller", "control board"), "robotics": ("robot", "robotics"), "embedded": ("embedded",),
    "electronics": ("electronic", "electronics"), "device": ("device",), "actuator": ("actuator",), "instrument": ("instrument",), "gateway": ("gateway",), "automation": ("automation",),
    "medical": ("medical",), "automotive": ("automotive",), "aerospace": ("aerospace",), "power": ("power electronics", "power system"), "battery": ("battery",), "motor": ("motor",),
    "camera": ("camera",), "measurement": ("measurement", "measuring"),
}
BROAD = ("industrial", "automation", "medical", "automotive", "aerospace")
EXCLUSIONS = {
    "marketing/SEO": ("marketing agency", "digital marketing", "seo agency", "seo services", "seo consultant", "advertising agency", "lead generation agency"),
    "recruitment": ("recruitment agency", "staffing agency", "job board", "executive search firm", "talent agency"),
    "directory operator": ("business directory", "company directory", "supplier directory", "manufacturer directory", "directory listing", "yellow pages"),
    "government": ("government agency", "government department", "government ministry", "ministry of", "municipal government", "official government website"),
    "education blog": ("education blog", "university blog", "college blog", "academic blog", "student blog"),
    "unrelated ecommerce": ("online fashion store", "fashion ecommerce", "clothing store", "apparel store", "beauty store", "jewelry store", "home decor store", "dropshipping store"),
    "PCB/EMS peer": ("pcb assembly", "printed circuit board assembly", "pcb manufacturer", "printed circuit board manufacturer", "pcba manufacturer", "smt assembly services", "ems", "contract electronics manufacturer"),
}
CONDITIONAL = {
    "software-only": ("saas", "software platform", "software development services", "software services", "cloud platform", "web application"),
    "consulting-only": ("consulting services", "consultancy", "management consulting", "engineering consulting company", "automation consulting", "design consulting"),
}
IDENTITY = {
    "software-only": (
        "software company", "software vendor", "software developer", "software platform", "saas", "saas company", "saas provider", "saas platform", "saas business",
        "cloud company", "cloud provider", "cloud platform", "cloud business",
    ),
    "consulting-only": ("consulting", "consulting company", "consulting firm", "consulting business", "consultancy"),
    "travel/tourism": (
        "travel agency", "travel publisher", "travel site", "travel website", "travel magazine", "travel blog", "travel blog affiliate", "travel blog affiliate guide", "travel blog tourism affiliate", "travel blog tourism affiliate guide",
        "tourism operator", "tourism publisher", "tourism site", "tourism website", "travel affiliate site", "travel affiliate website", "travel tourism affiliate site", "travel tourism affiliate website",
        "tourism affiliate site", "tourism affiliate website", "tourism tourism affiliate site", "tourism tourism affiliate website",
    ),
    "news/media": (
        "news publication", "news publisher", "news website", "news portal", "media outlet", "online magazine", "online magazine operator", "digital magazine", "digital magazine operator",
        "technology magazine", "technology magazine operator", "magazine publisher", "press release service",
    ),
}
OPERATED = {"software-only": ("software development service", "software development services"), "consulting-only": ("consulting service", "consulting services")}
DETERMINERS, OWN = ("our", "this", "the"), ("company", "business", "site", "publication")
VERBS = ("develop", "develops", "host", "hosts", "offer", "offers", "operate", "operates", "provide", "provides", "publishe", "publishes", "run", "runs", "sell", "sells")
GOES_ON = ("cover", "covering", "guide", "operate", "publishe", "publishing", "report", "reporting", "review", "reviewing", "run", "running", "tourism affiliate")
OBJECTS = "printed circuit boards?|control boards?|embedded systems?|sensors?|controllers?|robots?|actuators?|instruments?|gateways?|devices?|equipment|electronics?|cameras?|batter(?:y|ies)|motors?|adapters?"
MAKING = "manufactur(?:e|es|ed|ing)|manufacturers?|design(?:s|ed|ing)?|produc(?:e|es|ed|ing)|production|sell(?:s|ing)?|sold|sales?"
NOT_PHYSICAL = ("analytics", "application", "applications", "app", "apps", "cloud", "consulting", "dashboard", "dashboards", "for", "platform", "saas", "service", "services", "software", "to", "with")
OF_OTHERS = ("allow", "allows", "client", "clients", "customer", "customers", "enable", "enables", "help", "helps", "partner", "partners", "serve", "serves", "serving", "support", "supports", "supplier", "suppliers", "vendor", "vendors")
PEERS = ("pcb manufacturer", "printed circuit board manufacturer", "pcba manufacturer", "smt assembly services", "contract electronics manufacturer")

# Sources and sending.
NOT_COMPANIES = ("goodfirms.co", "enfsolar.com", "clutch.co", "designrush.com", "capterra.com", "g2.com", "iot.org.ar", "glassdoor.com", "indeed.com", "ziprecruiter.com", "monster.com", "godaddy.com", "prnewswire.com", "businesswire.com", "globenewswire.com")
LISTINGS = ("top ", "find a supplier", "encontra a tu proveedor", "manufacturers from", "manufacturers in", "supplier directory", "list of ")
LISTING_TITLES = ("distributors", "manufacturers", "suppliers", "company directory")
NOISE_HOSTS = ("linkedin.com", "indeed.com", "glassdoor.com", "youtube.com", "facebook.com", "x.com", "twitter.com", "wikipedia.org", "crunchbase.com")
DIRECTORIES = ("industrystock.com", "europages.com", "kompass.com", "directindustry.com", "medicalexpo.com", "thomasnet.com", "eventseye.com", "industrynet.com", "globalspec.com", "iqsdirectory.com", "exporthub.com", "odva.org", "digikey.com", "datasheetarchive.com", "hannovermesse.de", "mesago.com", "medica-tradefair.com", "automateshow.com", "ces.tech", "embedded-world.de", "electronica.de", "productronica.com", "automatica-munich.com", "compamed-tradefair.com", "thebatteryshow.eu", "thebatteryshow.com", "sensorsconverge.com", "mdmwest.com", "d2p.com", "eumweek.com", "ecocexhibition.com", "intersolar.de", "ees-europe.com", "intertraffic.com", "railtex.co.uk", "dsei.co.uk", "eurosatory.com")
HARDWARE = ("hardware", "electronics", "electronic", "device", "equipment", "instrument", "analyzer", "sensor", "controller", "control", "robot", "automation", "machine", "motor", "drive", "battery", "charger", "inverter", "medical", "embedded", "iot", "camera", "vision", "telecom", "wireless", "meter", "monitor", "laboratory", "lighting", "appliance", "mechatronic")
SOFTWARE = ("saas", "consulting", "cloud platform", "software services", "web agency")
IGNORED_QUERY_WORDS = ("argentina", "australia", "brazil", "canada", "chile", "company", "contact", "france", "germany", "italy", "manufacturer", "mexico", "netherlands", "new", "norway", "spain", "sweden", "switzerland", "tender", "united", "usa", "zealand")
ALLOWED_TYPES = ("Generic Company Email", "Public Work Email", "User Provided Verified Business Email")
UNRESOLVED = ("", "not found", "unknown", "n/a", "na", "未找到")
BLOCKED_HOSTS = ("wikipedia.org", "wikimedia.org")
BLOCKED_SOURCES = ("category:", "category/", "/category/", "list of companies", "government", "university", "college", "blog", "news", "affiliate", "travel", "marketing agency", "seo agency", "recruitment", "staffing", "job board")
BLOCKED_NAMES = ("wikipedia", "category", "list", "contact", "contact us", "legal notice", "disclaimer", "home", "about", "about us")
PAGE_TITLE = r"(?i)(?:\bcategory\b|\blist\b|\bcompanies\b|\bdevices?\s+is\b|\bis\s+[A-Z])"
OPT_OUT = "If you are not the right person or prefer not to receive further emails from us, please let me know and I will remove your contact from our list."
LINK_CLASSES = {"contact": ("contact", "kontakt"), "impressum": ("impressum", "imprint"), "legal": ("legal",), "privacy": ("datenschutz", "privacy"), "team": ("ansprechpartner", "team"), "careers": ("career", "jobs", "vacancies")}
FORM_LABELS, FORM_HREFS = ("contact", "kontakt", "inquiry", "enquiry", "request"), ("/contact", "/kontakt", "contact-form", "inquiry", "enquiry")
REGIONS = {"Germany": "DE", "Netherlands": "NL", "Sweden": "SE", "UK": "GB", "United Kingdom": "GB", "France": "FR", "Italy": "IT", "Spain": "ES", "USA": "US", "United States": "US", "Canada": "CA"}
GERMAN_PATHS, OTHER_PATHS = ("impressum", "kontakt", "legal-notice", "contact"), ("contact", "contact-us", "about", "support")
SECOND_PATHS = ("about-us", "legal", "company", "team", "sales", "distributors", "partners")

# Discovery and recovery.
SITE_LABELS = ("website", "homepage", "company site")
OUTBOUND = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "google.com", "bing.com")
NO_RECOVERY = ("abuse", "privacy", "legal", "cancellation", "noreply", "no-reply", "donotreply", "do-not-reply")
CITIES = (
    ("Berlin", "Munich", "München", "Hamburg", "Cologne", "Köln", "Stuttgart", "Düsseldorf", "Dresden", "Leipzig", "Bremen", "Aachen", "Karlsruhe", "Nuremberg", "Nürnberg"),
    ("Amsterdam", "Eindhoven", "Rotterdam", "Delft", "Utrecht", "Groningen"), ("Stockholm", "Gothenburg", "Göteborg", "Malmö", "Uppsala", "Lund"),
    ("London", "Cambridge", "Oxford", "Manchester", "Bristol", "Birmingham", "Edinburgh"),
)
ROTATING_PRODUCTS = (
    "battery management system manufacturer", "motor controller manufacturer", "servo drive manufacturer", "industrial controller manufacturer", "PLC manufacturer", "embedded controller manufacturer", "sensor module manufacturer",
    "industrial camera manufacturer", "machine vision camera manufacturer", "data acquisition system manufacturer", "test measurement equipment manufacturer", "laboratory instrument manufacturer", "medical device electronics manufacturer",
    "ultrasound device manufacturer", "patient monitor manufacturer", "IVD analyzer manufacturer", "wearable medical device manufacturer", "EV charger manufacturer", "solar inverter manufacturer", "energy storage controller manufacturer",
    "power electronics manufacturer", "RF module manufacturer", "microwave equipment manufacturer", "GNSS receiver manufacturer", "IoT gateway manufacturer", "edge AI device manufacturer", "industrial PC manufacturer", "FPGA board manufacturer",
    "AI camera manufacturer", "lidar manufacturer", "radar sensor manufacturer", "access control manufacturer", "security electronics manufacturer", "environmental monitoring device manufacturer", "water quality sensor manufacturer",
    "industrial printer manufacturer", "RFID reader manufacturer", "barcode scanner manufacturer", "payment terminal manufacturer", "vending machine electronics manufacturer", "audio equipment manufacturer", "professional audio manufacturer",
    "LED display controller manufacturer", "agricultural electronics manufacturer", "marine electronics manufacturer", "railway signaling equipment manufacturer",
)

# Terms that texts teach; a pattern and whether it is for any case.
LEARNED_PATTERNS = {
    "products": (r"\b(?:[A-Za-z][A-Za-z0-9+/-]*\s+){1,4}(?:equipment|systems?|devices?|controllers?|instruments?|cameras?|sensors?|terminals?|gateways?|servers?|scanners?|monitors?|robots?|electronics|hardware)\b", True),
    "job_titles": (r"\b(?:[A-Za-z][A-Za-z0-9+/-]*\s+){0,3}(?:Engineer|Manager|Director|Buyer|CTO)\b", False),
    "procurement_terms": (r"\b(?:[A-Za-z][A-Za-z0-9+/-]*\s+){0,3}(?:Manufacturing|Assembly|Prototype|Sourcing|Supplier|Build)\b", True),
}
REFUSED_TERMS = ("software", "software system", "pcb manufacturer", "pcba manufacturer", "contract electronics manufacturer")

# Headers of imported lists, in lower case.
MAIL_HEADERS = ("email", "email address", "contact email", "e-mail", "邮箱", "邮箱1", "邮箱2", "邮箱3", "企业邮箱", "企业邮箱1", "企业邮箱2", "企业邮箱3", "联系人邮箱")
MAIL_HEADER_STARTS = ("邮箱", "企业邮箱")
HEADERS = {
    "company_name": ("company name", "company", "name", "公司名称", "公司名称(en)", "公司名称（en）", "展商英文名称", "展商中文名称"),
    "website": ("website", "company website", "company url", "url", "网站", "官网", "公司官网"),
    "domain": ("domain", "company domain", "域名", "官网域名"),
    "contact_person": ("contact person", "contact name", "contact", "联系人", "联系人1", "联系人2"),
    "country": ("country", "国家", "国家/地区", "国家／地区"),
    "city": ("city", "城市", "市", "城市/国家"),
    "industry": ("industry", "行业", "客户领域", "命中领域(全部)", "命中领域（全部）", "应用领域", "产品服务", "产品/服务(摘要)", "产品/服务（摘要）", "产品类别1"),
    "source_url": ("source url", "source", "source link", "来源url", "来源链接", "数据来源链接"),
    "notes": ("notes", "note", "remarks", "备注", "判定依据", "展商优势", "展商简介", "公司简介(摘要)", "公司简介（摘要）"),
}

# Wording of generated searches.
JOBS, PROCUREMENT = ("Hardware Engineer", "Embedded Engineer", "Electronics Engineer"), ("PCB Assembly", "SMT", "PCBA sourcing")
INTENTS = ("email", "contact", "sales", "info", "Impressum", "Kontakt")
#: {c} country, {i} industry, {p} product, {j} job, {b} procurement, {x} and {y} rotating products.
TEMPLATES = {
    "batch": ('{c} "{i}" company manufacturer contact', '{c} "{p}" manufacturer', '{c} "{j}" electronics', '{c} (PCB OR PCBA OR "{b}") RFQ OR tender OR sourcing', '{c} electronics ("info@" OR "sales@" OR "contact@")', "{c} hardware manufacturer embedded electronics contact"),
    "email first": (*('{c} "{i}" "' + x + '"' for x in ("contact", "email", "sales@", "info@", "Impressum", "Kontakt")), '{c} "{x}" "contact"', '{c} "{y}" "contact"'),
    "prospect": ('{c} "{i}" manufacturer contact', '{c} "{p}" manufacturer contact', '{c} "{i}" exhibitor manufacturer', '{c} "{p}" manufacturer directory', '{c} "{p}" supplier directory', '{c} "{i}" association members manufacturers', '{c} "{p}" product directory manufacturers', '{c} "{p}" distributor partner manufacturer', '{c} "{i}" industrial directory manufacturers', '{c} "{p}" manufacturer catalog filetype:pdf'),
}
