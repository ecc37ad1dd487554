"""Keyword lists, target patterns, tags, defaults.

Every list here is a plain default that callers may replace; the functions
and operators take the tables as parameters.
"""

from __future__ import annotations

# --- Fixed values: host keyword lists (matched anywhere in the host, any case).
ENVIRONMENT_KEYWORDS: dict[str, tuple[str, ...]] = {
    "is_dev": ("dev", "development"),
    "is_staging": ("stg", "stage", "staging"),
    "is_uat": ("uat", "qa", "test"),
    "is_prod": ("prod", "production", "prd"),
    "is_dr": ("dr", "disaster", "recovery"),
}
SERVICE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "is_api": ("api", "rest", "graphql", "gateway"),
    "is_web": ("www", "web", "portal", "site"),
    "is_cdn": ("cdn", "static", "assets", "media"),
    "is_email": ("mail", "smtp", "imap", "pop3", "mx"),
    "is_database": ("db", "database", "mysql", "postgres", "mongo", "redis"),
    "is_admin": ("admin", "manage", "console", "dashboard"),
    "is_auth": ("auth", "login", "sso", "identity", "oauth"),
    "is_internal": ("internal", "intranet", "corp", "private"),
}
REGION_KEYWORDS: dict[str, tuple[str, ...]] = {
    "region_uk": ("uk", "gb", "london", "ldn"),
    "region_us": ("us", "usa", "america", "nyc", "sfo", "chi"),
    "region_hk": ("hk", "hongkong", "hong-kong"),
    "region_sg": ("sg", "singapore"),
    "region_eu": ("eu", "europe", "fra", "ams", "dub"),
    "region_apac": ("apac", "asia", "sydney", "tokyo", "mumbai"),
}
CLOUD_KEYWORDS: dict[str, tuple[str, ...]] = {
    "is_aws": ("amazonaws", "awsglobalaccelerator", "cloudfront"),
    "is_azure": ("azure", "azurewebsites", "trafficmanager.net"),
    "is_gcp": ("googleapis", "appspot", "cloudfunctions"),
    "is_cloudflare": ("cloudflare", "cdn-cgi"),
}
# Declared as an optional extra region.
EXTRA_REGION_KEYWORDS: dict[str, tuple[str, ...]] = {
    "region_menat": ("menat", "middle-east"),
}
HOST_KEYWORDS = {
    **ENVIRONMENT_KEYWORDS,
    **SERVICE_KEYWORDS,
    **REGION_KEYWORDS,
    **CLOUD_KEYWORDS,
}

# --- Fixed values: regular expressions over the record target (any case).
TARGET_CLOUD_PATTERNS: dict[str, tuple[str, ...]] = {
    "aws": (
        r"\.amazonaws\.com",
        r"\.awsglobalaccelerator\.com",
        r"\.cloudfront\.net",
        r"\.elb\.[a-z]+-[a-z]+-\d+\.amazonaws\.com",
        r"ap-east-\d+\.amazonaws",
        r"us-east-\d+\.amazonaws",
        r"eu-west-\d+\.amazonaws",
    ),
    "azure": (
        r"\.azure\.com",
        r"\.azurewebsites\.net",
        r"\.trafficmanager\.net",
        r"\.cloudapp\.net",
    ),
    "gcp": (
        r"\.googleapis\.com",
        r"\.appspot\.com",
        r"\.cloudfunctions\.net",
        r"\.run\.app",
    ),
    "akamai": (
        r"\.akamai\.net",
        r"\.akamaiedge\.net",
        r"\.akamaitechnologies\.com",
    ),
    "cloudflare": (r"\.cloudflare\.com", r"\.cloudflaressl\.com"),
}
TARGET_INFRA_PATTERNS: dict[str, str] = {
    "gslb": r"\.gslb[^\.]*\.",
    "dynp": r"\.dynp\.",
    "wv": r"\.wv\d+\.",
    "cloud1": r"\.cloud1\.",
    "nlb": r"-nlb-",
    "alb": r"-alb-",
    "cdn": r"\.cdn\.",
}
MAIL_POLICY_PATTERNS: dict[str, str] = {
    "dmarc": r"v=DMARC",
    "spf": r"v=spf",
    "dkim": r"v=DKIM",
}

# --- Fixed value: the strict pattern of a host name.
STRICT_HOST_PATTERN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\.?$"

# --- Fixed values: scan tags and description keywords.
SCAN_TAGS: tuple[str, ...] = (
    "cname_ip_present",
    "rxdomain",
    "no_host_records",
    "http_unreachable",
    "https_unreachable",
    "ssl_cert_error",
    "timeout",
    "dns_error",
)
DESCRIPTION_KEYWORDS: tuple[str, ...] = (
    "trading", "payment", "customer", "portal", "gateway", "email", "security",
    "risk", "compliance", "authentication", "mobile", "website", "api",
    "internal", "external", "banking", "retail", "corporate", "wealth",
    "insurance", "loan", "credit", "deposit", "transaction", "transfer",
)

# --- Fixed values: table contract.
NULL_TOKENS: tuple[str, ...] = ("", "NULL", "null", "None", "NA", "N/A")
REQUIRED_COLUMNS: tuple[str, ...] = ("fqdn", "record_type", "record_data", "appid")
KNOWN_RECORD_TYPES: tuple[str, ...] = (
    "A", "AAAA", "CNAME", "MX", "TXT", "NS", "PTR", "SRV", "SOA",
)
NEVER_FEATURES: tuple[str, ...] = (
    "id", "uuid", "dedup_hash", "created_at", "updated_at", "ods_updated_on",
    "ods_load_date",
)
NORMALIZED_TEXT_COLUMNS: tuple[str, ...] = (
    "fqdn", "record_data", "bus_domain", "bus_sub_domain",
)
TEXT_ROLE: tuple[str, ...] = ("fqdn", "record_data", "raw_fqdn")
NUMERIC_ROLE: tuple[str, ...] = ("num_dots", "appserviceid")
DEFAULT_CATEGORICAL_COLUMNS: tuple[str, ...] = (
    "record_type", "fqdn_source", "fqdn_status", "brand", "product", "market",
    "tech_environment", "country_code", "itso_id", "buslevel4", "buslevel5",
    "classification", "primary_channel", "market_group", "region", "sub_brand",
    "category",
)
INTERACTIONS: dict[str, tuple[str, str]] = {
    "market_brand": ("market", "brand"),
    "env_status": ("tech_environment", "fqdn_status"),
    "domain_country": ("bus_domain", "country_code"),
}
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "primary": ("fqdn", "record_type", "record_data", "fqdn_source", "fqdn_status"),
    "domain_derived": ("bus_domain", "bus_sub_domain", "domain_name", "country_code", "num_dots"),
    "business": ("brand", "product", "market", "market_group", "client_channel", "primary_channel"),
    "technical": ("tech_environment", "category", "nameserver"),
    "org_hierarchy": (
        "itso_id", "itso_name", "delegate_itso_id", "delegate_itso_name",
        "buslevel4", "buslevel5", "buslevel6",
        "itdevlevel4", "itdevlevel5", "itdevlevel6",
    ),
    "app_metadata": (
        "classification", "primary_channel", "market_group", "region",
        "sub_brand", "category",
    ),
}

# --- Fixed values: labels with a meaning.
ORPHAN_LABEL = 0
RARE_LABEL = -999
UNKNOWN_LABEL = -1

# --- A compact public-suffix table (an excerpt of the common public rules).
# Pass your own rules, in the same notation, for full coverage: "*.x" is a
# wildcard rule and "!a.x" an exception to one.
PUBLIC_SUFFIXES: tuple[str, ...] = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io",
    "ai", "app", "dev", "cloud", "online", "site", "tech", "xyz", "me", "tv", "cc",
    "co", "us", "ca", "eu", "asia", "mobi", "bank", "insurance",
    "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "net.uk", "me.uk",
    "au", "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "nz", "co.nz", "org.nz", "net.nz", "govt.nz", "ac.nz",
    "hk", "com.hk", "org.hk", "net.hk", "edu.hk", "gov.hk",
    "sg", "com.sg", "org.sg", "net.sg", "edu.sg", "gov.sg",
    "cn", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn",
    "in", "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "jp", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "kr", "co.kr", "or.kr", "tw", "com.tw", "org.tw", "my", "com.my", "th", "co.th",
    "id", "co.id", "ph", "com.ph", "vn", "com.vn",
    "br", "com.br", "net.br", "org.br", "gov.br", "mx", "com.mx", "ar", "com.ar",
    "cl", "pe", "com.pe", "za", "co.za", "org.za", "ae", "com.ae", "sa", "com.sa",
    "eg", "com.eg", "il", "co.il", "tr", "com.tr", "ru", "com.ru", "ua", "com.ua",
    "de", "fr", "it", "es", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "ie",
    "pl", "com.pl", "pt", "gr", "cz", "hu", "ro", "lu", "mt",
    "*.ck", "!www.ck", "*.er", "*.kh", "*.mm", "*.np",
)
