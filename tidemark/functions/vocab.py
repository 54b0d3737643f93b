"""Word lists, patterns, lookup tables and constants.

Everything in this module is a FIXED VALUE that the results depend on. It is data, stated
plainly and in its natural order; the logic that uses it lives in the operators.
"""

# ---------------------------------------------------------------- enumerations (fixed values)
GOALS = [
    "find_information", "comparison", "troubleshooting", "purchase", "local_service", "navigation",
    "draft_document", "collaborate", "organize", "analyze", "schedule", "learn", "create", "reflect",
]
USE_CASES = [
    "comparison", "learning", "troubleshooting", "verification", "entertainment",
    "community_engagement", "professional_development", "market_research",
]
CONSTRAINT_TYPES = ["inclusion", "exclusion", "range", "datatype"]
URGENCIES = ["immediate", "soon", "flexible", "exploratory"]
SKILL_LEVELS = ["beginner", "intermediate", "advanced", "expert"]
HORIZONS = ["immediate", "today", "week", "month", "longterm", "flexible"]
RECENCIES = ["breaking", "recent", "evergreen", "historical"]
FREQUENCIES = ["oneoff", "recurring", "exploratory", "flexible"]
ETHICAL_DIMENSIONS = ["privacy", "sustainability", "ethics", "accessibility", "openness"]
RESULT_TYPES = ["answer", "tutorial", "tool", "marketplace", "community"]
COMPLEXITIES = ["simple", "moderate", "advanced"]
CONSENT_TYPES = ["advertising", "analytics", "personalization", "data_sharing", "profiling"]

# ---------------------------------------------------------------- fraud (fixed values)
BOT_PATTERNS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests", "httpx", "headless",
    "phantom", "selenium", "puppeteer", "googlebot", "bingbot", "yandex", "baidu",
]
SUSPICIOUS_AGENTS = [r"^-$", r"^Mozilla/4\.0$"]
MOBILE_AGENT_WORDS = ["mobile", "android", "iphone", "ipad"]
MOBILE_SCREEN_BELOW = 768
SEVERITY_WEIGHT = {"low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}
RISK_HIGH, RISK_MEDIUM, RISK_LOW = 0.7, 0.5, 0.3

# ---------------------------------------------------------------- experiments (fixed values)
Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
Z_DEFAULT = 1.96

# ---------------------------------------------------------------- query constraints (fixed values)
PLATFORM_PATTERNS = [
    (r"\b(android|mobile|phone)\b", "Android"),
    (r"\b(ios|iphone|ipad|apple)\b", "iOS"),
    (r"\b(windows|pc|desktop)\b", "Windows"),
    (r"\b(mac|macos|macbook)\b", "macOS"),
    (r"\b(linux|ubuntu|debian|fedora)\b", "Linux"),
    (r"\b(web|browser|chrome|firefox|safari)\b", "Web"),
]
EXCLUSION_PATTERNS = [
    (r"\b(no\s+(google|gmail|android))\b", "provider", ["Google"]),
    (r"\b(no\s+(microsoft|outlook|windows))\b", "provider", ["Microsoft"]),
    (r"\b(no\s+(apple|ios|iphone|ipad))\b", "provider", ["Apple"]),
    (r"\b(no\s+(big\s+tech|big\s+corporations?))\b", "provider",
     ["Google", "Microsoft", "Apple", "Amazon", "Meta"]),
    (r"\b(not?\s+google|avoid\s+google)\b", "provider", ["Google"]),
    (r"\b(not?\s+microsoft|avoid\s+microsoft)\b", "provider", ["Microsoft"]),
    (r"\b(proprietary|closed\s+source)\b", "license", ["proprietary"]),
    (r"\b(open\s+source|oss|free\s+software)\b", "license", ["open-source"]),
]
PRICE_PATTERNS = [
    (r"\b(?:under|less than|below)\s*(\d+)\s*(?:rupees|rs|₹|dollars?|usd)\b", "<="),
    (r"\b(?:over|more than|above)\s*(\d+)\s*(?:rupees|rs|₹|dollars?|usd)\b", ">="),
]
FEATURE_PATTERNS = [
    (r"\b(end[-\s]*to[-\s]*end[-\s]*encrypt|e2e[-\s]*encrypt|end[-\s]*to[-\s]*end[-\s]*encrypted"
     r"|e2e[-\s]*encrypted)\b", "end-to-end_encryption"),
    (r"\b(end[-\s]*to[-\s]*end|e2e)\s+(encrypt|encryption)\b", "end-to-end_encryption"),
    (r"\b(encrypted|secure|private)\s+(email|mail)\b", "encrypted_email"),
    (r"\b(real[-\s]*time|instant)\s+(sync|collaboration)\b", "real-time_collaboration"),
    (r"\b(offline|local|on[-\s]*device)\s+(storage|sync)\b", "offline_capability"),
    (r"\b(ad[-\s]*free|no\s+ads|ad[-\s]*less)\b", "ad-free"),
]
NEGATIVE_PREFERENCE_PATTERNS = [
    (r"\b(no\s+big\s+tech|no\s+big\s+corporations?)\b", "no big tech"),
    (r"\b(no\s+proprietary|no\s+closed\s+source|open\s+source)\b", "no proprietary"),
    (r"\b(privacy[-\s]*first|privacy\s+focused)\b", "privacy-focused"),
]
# price words of the simple price reader: (pattern, operator)
PRICE_WORD_PATTERNS = [
    (r"\b(?:under|less than|below)\s*(\d+)\s*(?:rupees|rs|₹|dollars?|usd)?\b", "<="),
    (r"\b(?:over|more than|above)\s*(\d+)\s*(?:rupees|rs|₹|dollars?|usd)?\b", ">="),
    (r"\b(?:above|greater than)\s*(\d+)\s*(?:rupees|rs|₹|dollars?|usd)?\b", ">="),
]

# ---------------------------------------------------------------- query goals (fixed values)
# first goal with a hit wins, in this order
QUERY_GOAL_PATTERNS = [
    ("learn", [
        r"\b(how to|how do i|guide|tutorial|setup|configure|install|learn|teach me|explain|what is|tell me about)\b",
        r"\b(setup|configur|install|learn|tutorial|guide|manual|instructions?)\b",
        r"\b(explain|understand|know about|find out about)\b",
    ]),
    ("comparison", [
        r"\b(compare|comparing|versus|vs\.?|difference|better|best|alternative|alternatives?)\b",
        r"\b(which is|should i use|recommend|top|best|vs|versus)\b",
    ]),
    ("troubleshooting", [
        r"\b(fix|broken|not working|error|problem|issue|trouble|debug|cant|can't|won't|help)\b",
        r"\b(why is|not working|fix|troubleshoot|solve|resolve)\b",
    ]),
    ("purchase", [
        r"\b(buy|purchase|get|order|shop|price|cost|deal|discount|cheapest|where to buy)\b",
        r"\b(price|cost|buy|purchase|order|where to get)\b",
    ]),
    ("find_information", [
        r"\b(find|search|locate|where|when|who|what|information|details|about)\b",
        r"\b(what is|where is|when|who|information|details)\b",
    ]),
    ("local_service", [
        r"\b(near me|nearby|local|around here|closest|find near|find nearby)\b",
        r"\b(service|repair|mechanic|doctor|dentist|restaurant) near me\b",
    ]),
    ("navigation", [
        r"\b(go to|navigate to|directions|route|map|find location|address)\b",
        r"\b(directions|route|navigate|location|address|find the way)\b",
    ]),
]
QUERY_BEGINNER_PATTERNS = [
    r"\b(beginner|novice|newbie|new to|first time|just starting|basic|fundamental|simple)\b",
    r"\b(help me|need help|how do|what is|explain|for dummies|easy|simple)\b",
]
QUERY_ADVANCED_PATTERNS = [
    r"\b(advanced|expert|power user|custom|optimize|performance|technical|configuration|advanced settings)\b",
    r"\b(technical|configuration|advanced|expert|performance|optimization)\b",
]
# use case -> example sentences; only the first three words of each example are tested
QUERY_USE_CASE_EXAMPLES = [
    ("comparison", ["compare different email providers", "difference between services",
                    "which option is better", "evaluate alternatives"]),
    ("learning", ["how to set up email", "tutorial for beginners", "learn about encryption",
                  "guide to configure"]),
    ("troubleshooting", ["fix email not working", "troubleshoot connection issues",
                         "solve error messages", "debug problems"]),
    ("verification", ["verify account", "confirm email address", "validate credentials",
                      "check security"]),
    ("professional_development", ["advance career skills", "learn new technology",
                                  "professional growth", "career development"]),
]
# (dimension, preference) -> example sentences, tested in the same way
QUERY_ETHICAL_EXAMPLES = [
    ("privacy", "privacy-first", ["privacy protection", "data security", "no tracking",
                                  "private browsing", "secure communication", "privacy focused",
                                  "privacy-first approach", "protecting user privacy"]),
    ("openness", "open-source_preferred", ["open source software", "free and open",
                                           "community driven", "transparent code",
                                           "open development", "open source solution"]),
    ("ethics", "ethical_company", ["ethical business", "social responsibility",
                                   "environmental impact", "fair labor practices",
                                   "sustainable operations"]),
]
QUERY_RESULT_TYPE_WORDS = [
    ("tutorial", ["how to", "tutorial", "guide", "setup", "configure"]),
    ("community", ["compare", "versus", "vs", "difference", "alternative"]),
    ("marketplace", ["buy", "purchase", "price", "cost", "deal"]),
    ("answer", ["what is", "explain", "define", "describe"]),
]
QUERY_COMPLEXITY_WORDS = ["advanced", "expert", "technical", "configuration", "performance"]
URGENCY_WORDS = [
    ("immediate", ["urgent", "now", "immediately", "right now", "asap", "emergency"]),
    ("soon", ["today", "this week", "soon", "within days", "quick"]),
]
HORIZON_WORDS = [
    ("today", ["now", "today", "immediate", "urgent"]),
    ("week", ["this week", "weekly", "week"]),
    ("month", ["monthly", "month"]),
]
RECENCY_WORDS = [
    ("recent", ["latest", "new", "recent", "updated", "current"]),
    ("historical", ["old", "historical", "past", "archive"]),
]
FREQUENCY_WORDS = [
    ("recurring", ["every", "daily", "weekly", "monthly", "recurring", "repeat"]),
    ("oneoff", ["once", "single", "one time", "one-time"]),
]

# ---------------------------------------------------------------- page intent (fixed values)
PAGE_GOAL_PATTERNS = [
    (r"\b(how to|how do i|guide|tutorial|setup|configure|install|learn|teach me|explain|what is)\b", "learn"),
    (r"\b(setup|configur|install|learn|tutorial|guide|manual|instructions?)\b", "learn"),
    (r"\b(compare|comparing|versus|vs\.?|difference|better|best|alternative|alternatives?)\b", "comparison"),
    (r"\b(which is|should i use|recommend|top|best|vs|versus)\b", "comparison"),
    (r"\b(fix|broken|not working|error|problem|issue|trouble|debug|can't|won't|help)\b", "troubleshooting"),
    (r"\b(why is|not working|fix|troubleshoot|solve|resolve)\b", "troubleshooting"),
    (r"\b(buy|purchase|get|order|shop|price|cost|deal|discount|cheapest|where to buy)\b", "purchase"),
    (r"\b(price|cost|buy|purchase|order|where to get)\b", "purchase"),
    (r"\b(find|search|locate|where|when|who|what|information|details|about)\b", "find_information"),
    (r"\b(near me|nearby|local|around here|closest|find near|find nearby)\b", "local_service"),
    (r"\b(go to|navigate to|directions|route|map|find location|address)\b", "navigation"),
]
PAGE_GOAL_ORDER = ["learn", "comparison", "troubleshooting", "purchase", "find_information",
                   "local_service", "navigation"]
PAGE_USE_CASE_PATTERNS = [
    (r"\b(compare|difference|versus|vs|better|alternative)\b", "comparison"),
    (r"\b(how to|tutorial|guide|learn|setup|configure)\b", "learning"),
    (r"\b(fix|troubleshoot|error|problem|issue|debug|solve)\b", "troubleshooting"),
    (r"\b(verify|confirm|validate|check|authentication|security)\b", "verification"),
    (r"\b(learn|skills|career|professional|development|training)\b", "professional_development"),
    (r"\b(market|research|analysis|competitive|industry)\b", "market_research"),
]
PAGE_COMPLEXITY_PATTERNS = [
    (r"\b(beginner|novice|newbie|basic|fundamental|simple|easy|introduction)\b", "simple"),
    (r"\b(advanced|expert|mastery|technical|optimization|performance|custom)\b", "advanced"),
    (r"\b(intermediate|moderate|regular|standard|typical)\b", "moderate"),
]
PAGE_RESULT_TYPE_PATTERNS = [
    (r"\b(how to|tutorial|guide|step[- ]?by[- ]?step|walkthrough)\b", "tutorial"),
    (r"\b(compare|versus|vs|difference|alternative|review)\b", "community"),
    (r"\b(buy|purchase|price|deal|discount|shop)\b", "marketplace"),
    (r"\b(what is|explain|define|describe|meaning)\b", "answer"),
    (r"\b(tool|calculator|generator|converter|utility)\b", "tool"),
]
PAGE_ETHICAL_PATTERNS = [
    (r"\b(privacy[- ]?first|privacy[- ]?focused|data protection|no tracking|secure)\b", "privacy", "privacy-first"),
    (r"\b(open[- ]?source|foss|free software|libre|community driven)\b", "openness", "open-source"),
    (r"\b(sustainable|eco[- ]?friendly|carbon[- ]?neutral|green|environmental)\b", "sustainability", "sustainable"),
    (r"\b(ethical|fair trade|social responsibility|human rights)\b", "ethics", "ethical"),
    (r"\b(accessible|accessibility|inclusive|wcag|disability)\b", "accessibility", "accessible"),
]
PAGE_BEGINNER_PATTERN = r"\b(beginner|novice|newbie|basic|easy|simple|introduction|getting started)\b"
PAGE_ADVANCED_PATTERN = r"\b(advanced|expert|mastery|technical|complex|sophisticated)\b"
PAGE_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from"]
PAGE_TRIM_CHARS = ".,!?;:\"'()[]{}"
KEY_PHRASES = [
    "step-by-step", "how to", "best practices", "getting started", "quick start", "tutorial",
    "user guide", "api reference", "code example", "source code", "open source", "free software",
]
RELATED_GOALS = {
    "learn": ["find_information", "troubleshooting"],
    "comparison": ["purchase", "find_information"],
    "troubleshooting": ["learn", "find_information"],
    "purchase": ["comparison", "local_service"],
    "local_service": ["navigation", "purchase"],
    "navigation": ["local_service", "find_information"],
}

# ---------------------------------------------------------------- web page intent (fixed values)
WEB_GOAL_WORDS = [
    ("learn", ["tutorial", "guide", "how to", "howto", "learn", "introduction", "basics", "fundamentals",
               "course", "lesson", "step by step", "walkthrough", "beginner", "getting started"]),
    ("comparison", ["vs", "versus", "compare", "comparison", "better", "alternative", "review", "top 10",
                    "best", "difference between", "which is better", "head to head"]),
    ("troubleshooting", ["fix", "error", "problem", "issue", "troubleshoot", "debug", "solve", "not working",
                         "broken", "help", "won't", "cant", "can't"]),
    ("purchase", ["buy", "price", "purchase", "deal", "discount", "cheap", "where to buy", "cost", "pricing"]),
    ("find_information", ["what is", "definition", "explain", "overview", "introduction", "about", "meaning",
                          "examples"]),
]
WEB_USE_CASE_WORDS = [
    ("learning", ["tutorial", "learn", "study", "course", "education", "training"]),
    ("comparison", ["compare", "review", "best", "top", "versus", "alternative"]),
    ("troubleshooting", ["fix", "error", "problem", "issue", "solution"]),
    ("professional_development", ["career", "professional", "skills", "certification", "job"]),
    ("market_research", ["market", "industry", "trends", "analysis", "report"]),
]
WEB_RESULT_TYPE_WORDS = [
    ("tutorial", ["tutorial", "guide", "steps", "walkthrough"]),
    ("tool", ["tool", "software", "app", "application", "calculator"]),
    ("marketplace", ["buy", "price", "purchase", "shop", "store", "deal"]),
    ("answer", ["what is", "definition", "answer", "meaning"]),
    ("community", ["forum", "discussion", "reddit", "community", "ask"]),
]
WEB_BEGINNER_WORDS = ["beginner", "introduction", "basics", "fundamentals", "101", "for dummies",
                      "getting started", "easy", "simple"]
WEB_ADVANCED_WORDS = ["advanced", "expert", "deep dive", "master", "professional", "enterprise", "complex",
                      "optimization", "architecture"]
WEB_STOP_WORDS = """the a an and or but in on at to for of with by from is are was were be been being have has
had do does did will would could should may might must shall can this that these those it its as if then than
so such not no yes you your we our they their he she his her""".split()

# simple one-pass page tags
TAG_GOAL_WORDS = [
    ("troubleshooting", ["fix", "error", "problem", "issue", "troubleshoot"]),
    ("comparison", ["compare", "vs", "versus", "better", "best"]),
    ("purchase", ["buy", "price", "cost", "purchase"]),
]
TAG_TOPICS = ["tutorial", "guide", "example", "function", "package", "api", "web", "database"]

# ---------------------------------------------------------------- URL knowledge (fixed values)
# domain: (privacy score, tracker count, type, open source, non profit)
PRIVACY_DOMAINS_V1 = {
    "protonmail.com": (0.95, 0, "service", True, False),
    "proton.me": (0.95, 0, "service", True, False),
    "tutanota.com": (0.95, 0, "service", True, False),
    "tuta.io": (0.95, 0, "service", True, False),
    "duckduckgo.com": (0.9, 0, "search", False, False),
    "startpage.com": (0.85, 1, "search", False, False),
    "searx.org": (0.95, 0, "search", True, False),
    "searxng.org": (0.95, 0, "search", True, False),
    "github.com": (0.8, 1, "code", True, False),
    "gitlab.com": (0.85, 0, "code", True, False),
    "sourceforge.net": (0.75, 2, "code", True, False),
    "brave.com": (0.9, 0, "software", True, False),
    "mozilla.org": (0.85, 1, "software", True, False),
    "wikipedia.org": (0.9, 0, "encyclopedia", True, True),
    "wikimedia.org": (0.9, 0, "encyclopedia", True, True),
    "mullvad.net": (0.95, 0, "vpn", True, False),
    "nordvpn.com": (0.8, 1, "vpn", False, False),
    "fsf.org": (0.9, 0, "organization", True, True),
    "opensource.org": (0.9, 0, "organization", True, True),
}
TRACKERS_V1 = """google.com facebook.com twitter.com linkedin.com doubleclick.net google-analytics.com
googletagmanager.com facebook.net hotjar.com segment.io mixpanel.com criteo.com taboola.com outbrain.com
amazon-adsystem.com""".split()
BIG_TECH_V1 = """google.com googleusercontent.com googledrive.com facebook.com instagram.com whatsapp.com
messenger.com microsoft.com outlook.com live.com onedrive.com amazon.com aws.amazon.com apple.com icloud.com
twitter.com x.com tiktok.com bytedance.com""".split()
CONTENT_TYPE_WORDS_V1 = [
    ("article", ["blog", "news", "article", "post", "story"]),
    ("documentation", ["docs", "documentation", "wiki", "manual", "guide"]),
    ("tool", ["tool", "generator", "converter", "calculator", "checker"]),
    ("forum", ["forum", "discussion", "community", "board"]),
    ("code", ["github", "gitlab", "sourceforge", "code", "repository"]),
    ("download", ["download", "release", "file"]),
]
CONTENT_DESCRIPTION_V1 = {
    "article": "Article and blog content",
    "documentation": "Documentation and guides",
    "tool": "Online tool and utilities",
    "forum": "Community discussion forum",
    "code": "Source code repository",
    "download": "Software downloads",
    "general": "Web resource",
}
PRIVACY_DOMAINS_V2 = """protonmail.com tutanota.com mailbox.org startmail.com duckduckgo.com startpage.com
searx.space qwant.com firefox.com mozilla.org brave.com torproject.org mullvad.net ivpn.net protonvpn.com
nordvpn.com privacytools.io privacyguides.org ssd.eff.org github.com gitlab.com codeberg.org sourcehut.org
wikipedia.org wikimedia.org ubuntu.com debian.org archlinux.org fedoraproject.org""".split()
BIG_TECH_V2 = """google.com google.co youtube.com gmail.com android.com chrome.com googleapis.com
googleusercontent.com microsoft.com windows.com office.com outlook.com hotmail.com live.com msn.com bing.com
apple.com icloud.com me.com mac.com facebook.com instagram.com whatsapp.com messenger.com amazon.com amazon.co
aws.amazon.com alexa.com twitter.com x.com tweetdeck.com linkedin.com licdn.com tiktok.com tiktokv.com""".split()
TRACKERS_V2 = """google-analytics.com googletagmanager.com googleadservices.com doubleclick.net
googlesyndication.com googleapis.com facebook.net facebook.com fbcdn.net amazon-adsystem.com amazon.com
twitter.com twimg.com linkedin.com licdn.com outbrain.com taboola.com criteo.com criteo.net adnxs.com
appnexus.com pubmatic.com rubiconproject.com openx.net openx.com scorecardresearch.com comscore.com
quantserve.com quantcount.com moatads.com moatpixel.com""".split()
CONTENT_TYPE_WORDS_V2 = [
    ("documentation", ["/docs/", "/documentation/", "/wiki/", "/help/", "/guide/", "/manual/"]),
    ("article", ["/blog/", "/article/", "/post/", "/news/", "/story/"]),
    ("forum", ["/forum/", "/community/", "/discuss/", "/thread/", "/topic/"]),
    ("video", ["/video/", "/watch/", "/v/", "/youtube.com/", "/vimeo.com/"]),
    ("image", ["/image/", "/photo/", "/gallery/", "/img/", "/pic/"]),
    ("tool", ["/tool/", "/app/", "/calculator/", "/converter/", "/generator/"]),
    ("download", ["/download/", "/file/", "/software/", "/install/"]),
]
OPEN_SOURCE_V2 = """github.com gitlab.com codeberg.org sourcehut.org apache.org mozilla.org gnu.org linux.org
debian.org ubuntu.com archlinux.org fedoraproject.org""".split()
NON_PROFIT_V2 = [".org", "wikipedia.org", "wikimedia.org", "eff.org", "mozilla.org", "apache.org", "gnu.org"]
AUTHORITY_DOMAINS = {
    "wikipedia.org": 0.95, "github.com": 0.9, "mozilla.org": 0.85, "stackoverflow.com": 0.85,
    "medium.com": 0.75, "dev.to": 0.7,
}
AUTHORITY_DEFAULT = 0.5
RESULT_FILTER_BIG_TECH = ["google.com", "facebook.com", "amazon.com", "microsoft.com", "apple.com",
                          "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid",
                   "ref", "source", "medium", "campaign", "session", "sessionid", "sid", "pk_campaign", "pk_kwd"]
PAGE_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx"]
URL_WEIGHTS_V1 = {"relevance": 0.35, "privacy": 0.25, "quality": 0.20, "ethics": 0.20}
URL_WEIGHTS_V2 = {"relevance": 0.40, "privacy": 0.30, "quality": 0.20, "ethics": 0.10}
PRIVACY_QUERY_WORDS = ["privacy", "secure", "encrypted", "anonymous"]

# ---------------------------------------------------------------- crawl rules (fixed values)
CRAWL_SKIP_PATTERNS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".zip", ".rar", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".mov", ".css", ".js", ".woff", ".woff2",
    "login", "signup", "register", "checkout",
]
CRAWL_BLOCKED_DOMAINS = ["facebook.com", "twitter.com", "instagram.com", "linkedin.com"]
SEED_SKIP_WORDS = ["facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "netflix.com",
                   "amazon.com", "login", "signup", "register"]
SEED_SKIP_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".tar", ".gz", ".mp3", ".mp4",
                        ".avi", ".mov", ".css", ".js", ".woff", ".woff2"]
KNOWN_DOMAINS = ["go.dev", "golang.org", "pkg.go.dev", "github.com/golang"]

# ---------------------------------------------------------------- ads and services (fixed values)
AD_FORBIDDEN_DIMENSIONS = [
    "age", "gender", "income", "race", "ethnicity", "political_affiliation", "religious_belief",
    "health_condition", "sexual_orientation", "location", "behavior", "interests", "purchasing_history",
    "browsing_history", "device_fingerprint", "ip_address",
]
COMPLIANCE_FORBIDDEN_DIMENSIONS = [
    "age", "gender", "income", "race", "ethnicity", "political_affiliation", "religious_belief",
    "health_condition", "sexual_orientation", "precise_location", "behavior", "interests",
    "purchasing_history", "browsing_history", "device_fingerprint", "ip_address",
]
AD_GOAL_WORDS = {
    "learn": ["guide", "tutorial", "how to", "learn", "explain", "setup", "configure"],
    "purchase": ["buy", "purchase", "price", "cost", "deal", "offer", "sale"],
    "comparison": ["compare", "versus", "vs", "difference", "alternative", "best"],
    "troubleshooting": ["fix", "solve", "problem", "issue", "troubleshoot", "error"],
    "create": ["create", "make", "build", "design", "generate", "produce"],
    "draft_document": ["document", "doc", "write", "draft", "text"],
    "collaborate": ["collaborate", "share", "team", "together", "cooperate"],
    "organize": ["organize", "arrange", "structure", "plan", "order"],
    "analyze": ["analyze", "analysis", "data", "insight", "metric"],
    "schedule": ["schedule", "calendar", "meeting", "appointment", "book"],
    "find_information": ["find", "search", "look", "discover", "information"],
    "local_service": ["local", "nearby", "service", "near me"],
    "navigation": ["navigation", "map", "direction", "route", "location"],
}
FORMAT_TAGS = ["pdf", "doc", "video", "audio", "interactive", "text"]
PRIVACY_TEXT_WORDS = ["privacy", "encrypted", "secure", "private"]
OPEN_TEXT_WORDS = ["open source", "foss", "free software"]

# ---------------------------------------------------------------- topics (fixed values)
TOPIC_STOP_WORDS = """the a an and or but in on at to for of with by from is are was were be been being have has
had do does did will would could should may might must shall can need how what when where why which who whom
whose i you he she it we they me him her us them my your his its our their mine yours tutorial guide examples
example learn learning best top free online course courses 2024 2025 2026""".split()
# category, keywords, patterns, validation substrings, related topics
TOPIC_CATEGORIES = [
    ("go_language", ["go", "golang", "go lang", "golang lang"], [r"\bgo\b", r"\bgolang\b"],
     ["go", "golang"], ["concurrency", "goroutines", "channels", "modules"]),
    ("python", ["python", "django", "flask", "fastapi", "pandas", "numpy", "pytorch"],
     [r"\bpython\b", r"\bdjango\b", r"\bflask\b", r"\bfastapi\b"],
     ["python", "django", "flask", "fastapi", "pandas"],
     ["data science", "machine learning", "web development", "automation"]),
    ("web_dev", ["javascript", "typescript", "react", "vue", "angular", "css", "html", "nodejs", "node.js",
                 "next.js"],
     [r"\bjs\b", r"\breact\b", r"\bvue\b", r"\bangular\b", r"\bnode\.?js\b"],
     ["javascript", "react", "vue", "angular", "css", "html", "node", "typescript"],
     ["frontend", "backend", "fullstack", "frameworks"]),
    ("devops", ["docker", "kubernetes", "k8s", "ci/cd", "jenkins", "aws", "azure", "gcp", "terraform", "ansible",
                "prometheus", "grafana"],
     [r"\bdocker\b", r"\bkubernetes\b", r"\bk8s\b", r"\baws\b", r"\bazure\b"],
     ["docker", "kubernetes", "k8s", "ci/cd", "jenkins", "aws", "azure", "gcp", "terraform"],
     ["cloud", "infrastructure", "monitoring", "automation"]),
    ("programming", ["programming", "coding", "software", "algorithm", "data structure", "design pattern"],
     [r"\bprogramming\b", r"\bcoding\b", r"\balgorithm\b"],
     ["programming", "coding", "software", "algorithm", "data structure"],
     ["best practices", "clean code", "architecture", "testing"]),
    ("rust", ["rust", "rustlang", "rust lang"], [r"\brust\b"], ["rust"],
     ["systems programming", "webassembly", "performance"]),
]
TOPIC_DEFAULT_CATEGORY = "programming"
TOPIC_SUFFIXES = ["tutorial", "examples", "best practices", "guide"]
AUTHORITATIVE_PATTERNS = [".org", ".edu", ".gov", "github.com", "stackoverflow.com", "medium.com", "dev.to",
                          "freecodecamp.org", "tutorialspoint.com", "w3schools.com", "geeksforgeeks.org"]

# ---------------------------------------------------------------- governance (fixed values)
PII_FIELDS = ["ip_address", "user_agent", "user_id", "email", "name", "location", "device_id"]
MINIMISATION_FIELDS = {
    "click_tracking": ["ip_hash", "user_agent_hash"],
    "conversion_tracking": ["value", "conversion_type"],
    "ad_metrics": ["impression_count", "click_count", "conversion_count"],
}
# retention class -> hours kept
RETENTION_HOURS = {"temporary": 1, "short_term": 24, "medium_term": 168, "long_term": 720, "permanent": 876000}
# full-text scoring parameters published by this repo
BM25_K1, BM25_B = 1.2, 0.75
INDEX_STOP_WORDS = """a an and are as at be but by for if in into is it no not of on or such that the their then
there these they this to was will with""".split()
