"""Lists, weights and patterns that results depend on."""

# Top-level domains that attract abuse.
RISKY_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "club", "info", "online", "site", "website", "space", "tech", "zip", "click", "download"]
# Suffixes that stand for an institution, and country codes, when seen as inner labels.
PROTECTED_TLDS = ["gov", "edu", "mil", "ac", "org", "gov.in", "gov.uk", "gov.au", "gov.ca", "gov.sg", "ac.uk", "edu.au", "mil.uk"]
COUNTRY_TLDS = ["in", "uk", "au", "de", "fr", "cn", "ru", "br", "jp", "kr", "sg", "nz", "za", "nl", "se", "no", "dk", "fi", "es", "it", "pl", "ch", "at", "be", "gr", "ie", "pt", "cz"]
# Suffixes and the countries that may host them, in order of precedence.
GEO_TLDS = {"gov.in": ["IN"], "gov.uk": ["GB", "UK"], "gov.au": ["AU"], "gov.ca": ["CA"], "gov.sg": ["SG"], "gov": ["US"], "mil": ["US"], "ac.uk": ["GB", "UK"], "edu.au": ["AU"], "mil.uk": ["GB", "UK"]}
BAD_NAMESERVERS = ["freenom", "njalla", "1984hosting", "shinjiru", "flokinet", "cyberbunker", "ecatel"]
# Hosting providers and points, in order of precedence.
HOSTING_POINTS = {"namecheap": 8, "hostinger": 10, "bluehost": 6, "godaddy": 5, "ovh": 7, "digitalocean": 5, "contabo": 12, "shinjiru": 15, "flokinet": 18, "njalla": 20, "1984hosting": 15, "cyberbunker": 25, "ecatel": 20, "bulletproof": 30, "offshore": 25}
COUNTRY_POINTS = {"NG": 20, "RU": 18, "CN": 15, "KP": 25, "RO": 12, "UA": 12, "VN": 10, "ID": 10, "TR": 10, "PK": 10, "BD": 10, "KZ": 10, "BY": 12, "IN": 5, "BR": 5, "MX": 5, "PH": 5, "TH": 5, "US": -5, "GB": -5, "CA": -5, "AU": -5, "JP": -5, "DE": -5, "FR": -5, "NL": -5, "CH": -5, "SE": -5}
FREE_NAMESERVERS = ["afraid.org", "no-ip.com", "dyndns.org", "cloudflare", "freenom", "dot.tk"]
BULLETPROOF = ["offshore", "anonymous", "bulletproof", "dmca ignore", "abuse resistant", "complaint resistant"]
RESIDENTIAL = ["residential", "broadband", "dsl", "cable", "telecom"]
BUDGET_REGISTRARS = ["namecheap", "godaddy", "namesilo", "porkbun", "freenom", "dot.tk", "hostinger", "name.com"]
# Paths and files of kits and points; the first path found counts.
KIT_PATHS = {"/admin/": 10, "/panel/": 10, "/verify/": 12, "/validation/": 12, "/secure/": 8, "/update/": 10, "/confirm/": 10, "/suspended/": 15, "/locked/": 15, "/webscr": 15, "/.well-known/": 8, "/includes/": 8, "/assets/": 5, "/process/": 10, "/submit/": 8, "/redirect/": 10, "/gateway/": 10, "/authentication/": 12, "/2fa/": 12, "/otp/": 12}
KIT_FILES = {"index.php": 5, "login.php": 8, "verify.php": 12, "process.php": 10, "submit.php": 10, "confirm.php": 10, "update.php": 10, "secure.php": 10, "validation.php": 12, "authenticate.php": 12, "signin.php": 8, "account.php": 8, "webscr.php": 15}
QUERY_WORDS = ["id", "token", "session", "key", "auth", "verify", "confirm"]
CREDENTIAL_PATHS = ["/signin/", "/login/", "/account/", "/myaccount/", "/banking/", "/secure/", "/auth/", "/portal/"]
BADGE_WORDS = ["ssl", "secure", "verified", "trusted", "safe"]
PARKING_MARKERS = {"domain for sale": 15, "buy this domain": 15, "this domain is parked": 20, "make an offer": 12, "inquire about this domain": 12, "sponsored listings": 10, "related searches": 8, "domain may be for sale": 12, "get this domain": 12, "premium domain": 10, "backorder this domain": 10, "register your domain": 8, "this page is parked": 15, "under construction": 8, "coming soon": 6, "website coming soon": 8, "stay tuned": 5}
PARKING_NAMESERVERS = ["sedoparking.com", "parkingcrew.net", "bodis.com", "dns-parking.com", "cashparking.com", "dan.com", "undeveloped.com", "afternic.com", "hugedomains.com", "sav.com", "epik.com", "dynadot.com", "uniregistrymarket.link", "parklogic.com", "above.com", "voodoo.com", "parkweb.com", "domainnameshop.com", "domainmarket.com", "registrar-servers.com", "domaincontrol.com", "plesk.com", "register.com", "name.com", "fastpark.net", "domain-parking.net"]
PARKING_URLS = ["sedo.com", "dan.com", "afternic.com", "hugedomains.com", "godaddy.com/domainfind", "uniregistry.com", "flippa.com", "brandbucket.com", "brandroot.com"]
PARKING_SERVERS = ["parkingcrew", "sedoparking", "bodis", "dan.com"]
# Regular expressions of parked pages and of phishing language, over lower-cased text.
PARKING_PATTERNS = [r"parked\s+domain", r"domain\s+for\s+sale", r"buy\s+this\s+domain", r"domain\s+is\s+available", r"domain\s+parking", r"expired\s+domain", r"godaddy\.com.*parking", r"sedo\.com", r"afternic\.com", r"namecheap.*parking", r"this\s+domain\s+may\s+be\s+for\s+sale", r"future\s+home\s+of", r"coming\s+soon", r"under\s+construction", r"domain\s+name\s+is\s+registered"]
PARKING_HOSTS = ["sedo.com", "godaddy.com", "afternic.com", "parkingcrew", "sedoparking"]
LANGUAGE_PATTERNS = [r"verify\s+your\s+account", r"suspended\s+account", r"unusual\s+activity", r"confirm\s+your\s+identity", r"security\s+alert", r"action\s+required", r"click\s+here\s+to\s+verify", r"update\s+payment\s+method", r"account\s+will\s+be\s+closed"]
TITLE_BRANDS = ["bank", "paypal", "amazon", "microsoft", "apple", "google", "facebook"]
FORM_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".work", ".click", ".link", ".zip", ".icu", ".loan", ".download", ".racing"]
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "t.co", "rebrandly.com", "short.io", "cutt.ly", "is.gd", "v.gd"]
FREE_HOSTS = ["000webhostapp.com", "infinityfreeapp.com", "netlify.app", "vercel.app", "herokuapp.com", "repl.co", "glitch.me"]
TRUSTED_ISSUERS = ["Let's Encrypt", "DigiCert", "GoDaddy", "Comodo", "Sectigo", "GlobalSign", "Entrust", "Amazon", "Google Trust Services", "IdenTrust", "Baltimore", "ISRG"]
PAGE_KEYWORDS = ["verify", "urgent", "suspended", "password", "account", "reset", "update", "limited", "confirm", "login", "sign in", "secure", "blocked"]
NOISE_LABELS = ["cpanel", "cpcalendars", "cpcontacts", "webdisk", "webmail", "autodiscover", "autoconfig", "whm", "mail", "ns1", "ns2", "imap", "pop", "smtp"]
GENERIC_TOKENS = ["mail", "email", "account", "accounts", "web", "www", "app", "api", "admin", "login", "secure", "bank", "net", "online", "service", "services", "portal", "user", "customer", "support"]
# JavaScript: a regular expression per pattern; keyloggers need two of theirs.
JS_REDIRECT = r"window\.location\s*=|window\.location\.href\s*=|window\.location\.replace\s*\(|document\.location\s*=|location\.href\s*=|location\.replace\s*\("
JS_FORM = r"\.action\s*=|\.submit\s*\(|setattribute\s*\(\s*['\"]action['\"]"
JS_KEYS = [r"addeventlistener\s*\(\s*['\"]keypress['\"]", r"addeventlistener\s*\(\s*['\"]keydown['\"]", r"addeventlistener\s*\(\s*['\"]keyup['\"]", r"onkeypress\s*=", r"onkeydown\s*=", r"\.keycode", r"\.key\s*=="]
# Hosting services by host suffix: name, suffixes, risk, type.
# A name that ends with a dot may stand anywhere in a host.
HOSTING_SERVICES = [
    ("ngrok", ["ngrok.io", "ngrok-free.app"], "critical", "tunnel"),
    ("localtunnel", ["loca.lt", "localtunnel.me"], "critical", "tunnel"),
    ("serveo", ["serveo.net"], "critical", "tunnel"),
    ("localhost.run", ["localhost.run"], "critical", "tunnel"),
    ("pagekite", ["pagekite.me"], "critical", "tunnel"),
    ("vercel", ["vercel.app", "vercel.dev", "now.sh"], "high", "serverless"),
    ("netlify", ["netlify.app", "netlify.com"], "high", "serverless"),
    ("render", ["render.com", "onrender.com"], "high", "serverless"),
    ("railway", ["railway.app", "up.railway.app"], "high", "serverless"),
    ("fly.io", ["fly.dev", "fly.io"], "high", "serverless"),
    ("heroku", ["herokuapp.com"], "medium", "paas"),
    ("replit", ["repl.co", "replit.dev", "replit.app"], "high", "ide"),
    ("glitch", ["glitch.me"], "medium", "ide"),
    ("cloudflare-pages", ["pages.dev"], "medium", "edge"),
    ("github-pages", ["github.io"], "low", "static"),
    ("gitlab-pages", ["gitlab.io"], "low", "static"),
    ("surge", ["surge.sh"], "medium", "static"),
    ("firebase", ["firebaseapp.com", "web.app"], "medium", "hosting"),
    ("bitly", ["bit.ly", "bitly.com"], "high", "shortener"),
    ("tinyurl", ["tinyurl.com"], "high", "shortener"),
    ("rebrandly", ["rebrandly.com", "link."], "high", "shortener"),
    ("wix", ["wixsite.com", "wix.com"], "medium", "builder"),
    ("weebly", ["weebly.com"], "medium", "builder"),
    ("wordpress-com", ["wordpress.com"], "low", "builder"),
    ("webflow", ["webflow.io"], "low", "builder"),
    ("infinityfree", ["infinityfreeapp.com"], "high", "free-hosting"),
    ("000webhost", ["000webhostapp.com"], "high", "free-hosting"),
]
# Endings that the first and the third pass of lookalike variants draw on (G3).
COMMON_TLDS = [
    "com", "net", "org", "info", "online", "app", "site", "xyz", "shop", "top", "io", "co", "me", "live", "click", "help", "link", "store", "pro",
    "buzz", "cloud", "dev", "world", "vip", "loans", "finance", "money", "credit", "services", "support", "center", "global", "group", "tech",
    "digital", "secure", "bank", "life", "today", "now", "biz", "name", "mobi", "email", "news", "work", "company", "solutions", "network", "systems",
    "consulting", "capital", "ventures", "holdings", "partners", "associates",
]
# Endings of the second pass (G3).
REGIONAL_TLDS = [
    "in", "co.in", "gov.in", "nic.in", "ac.in", "res.in", "net.in", "org.in", "ind.in", "firm.in", "gen.in", "edu.in", "mil.in", "sbi", "bharat",
    "এভারত", "ভারত", "ਭਾਰਤ", "ભારત", "ଭାରତ", "భారత్", "ಭಾರತ", "ഭാരതം", "இந்தியா", "بھارت",
]
# Words of the third pass (G3).
RISK_WORDS = [
    "secure", "verify", "login", "signin", "update", "alert", "confirm", "customer", "support", "official", "security", "blocked", "suspended",
    "expired", "renewal", "activate", "validation", "authenticate", "unlock", "restore", "recover", "reset", "helpdesk", "helpline", "service",
    "assistance", "urgent", "action", "required", "important", "notice", "notification", "warning", "critical", "immediate", "temporary", "emergency",
    "lockout", "frozen", "restricted", "limited", "pending", "awaiting", "processing", "verification", "protected", "safeguard", "certified",
    "validated", "authorized", "genuine", "authentic", "legitimate", "trusted", "verified", "approved", "registered", "validated", "customer-care",
    "toll-free", "helpline-number", "contact-us", "reach-us", "call-now", "click-here", "update-now", "verify-now", "login-here", "secure-login",
    "net-banking", "internet-banking", "mobile-banking", "online-banking", "e-banking", "digital-banking", "web-banking",
]
# The declarative rules for parked pages (H13): patterns of titles, names of parking firms, their hosts, patterns of bodies,
# characters of a body that count, and rules from which a page counts as parked.
PARKING_RULE_TITLES = [r"\b(domain|this domain) (is )?for sale\b", r"\b(domain parked|parked domain)\b", r"\bbuy this domain\b"]
PARKING_RULE_BRANDS = [r"\bsedo\b", r"\bparkingcrew\b", r"\bbodis\b", r"\bafternic\b", r"\buniregistry\b", r"\bdan\.com\b", r"\bhugedomains\b"]
PARKING_RULE_HOSTS = ["sedo.com", "parkingcrew.net", "bodis.com", "afternic.com", "dan.com", "hugedomains.com"]
PARKING_RULE_HINTS = [r"This domain is for sale", r"Buy now on", r"Make an offer"]
PARKING_RULE_CHARS, PARKING_RULE_LEAST = 50_000, 3
