"""Dictionaries, thresholds and patterns whose exact content defines results."""

from __future__ import annotations

# Fixed values (news).
SOURCE_PRIORITY = {"wgrz": 0.90, "spectrum_buffalo": 0.90, "city_of_buffalo": 0.95, "ub": 0.75, "wkbw": 0.85, "wgr550": 0.85, "wivb": 0.80}
SOURCE_DEFAULT = 0.5
TOPIC_PRIORITY = {"news": 0.80, "sports": 0.70, "weather": 0.85, "traffic": 0.60, "civic": 0.90, "education": 0.60, "other": 0.40}
TOPIC_DEFAULT = 0.4
TEAMS = (
    ("bills", ("buffalo bills", "nfl draft", "josh allen", "bills stadium", "bills game", "bills roster", "bills trade"), 0.15),
    ("sabres", ("sabres", "buffalo sabres", "nhl"), 0.12),
    ("bisons", ("bisons", "buffalo bisons"), 0.08),
    ("bandits", ("bandits", "buffalo bandits", "nll"), 0.08),
    ("ub", ("ub bulls", "university at buffalo athletics", "ub football", "ub basketball"), 0.06),
)
WEATHER = ("weather", "forecast", "snow", "lake effect", "blizzard", "tornado", "severe storm", "heat advisory", "wind chill")
TRAFFIC = ("traffic", "accident", "closure", "detour", "i-90", "i-190", "thruway", "kensington", "scajaquada")
CIVIC = ("city hall", "common council", "mayor", "ordinance", "public hearing", "road closure", "water main", "snow emergency", "parking ban")
OFFICIAL = ("city_of_buffalo",)
RANK_WEIGHTS = {"recency": 0.30, "source_priority": 0.20, "topic_priority": 0.15, "sports_boost": 0.10, "cross_source_boost": 0.15, "official_source_boost": 0.10}
TITLE_RATIO, TITLE_HOURS, AGE_HOURS = 75.0, 24, 72
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "ocid", "ncid", "cmpid")
SECTION_ORDER = ("news", "sports", "civic", "weather", "traffic", "education", "other")

# Fixed values (mail).
BULK_DOMAINS = (
    "mailchimp.com", "mail.mailchimp.com", "hubspot.com", "hubspotmail.com", "sendgrid.net", "sendgrid.com", "constantcontact.com",
    "mailgun.org", "mailgun.net", "amazonses.com", "salesforce.com", "exacttarget.com", "marketo.com", "mktomail.com", "pardot.com",
    "intercom.io", "intercommail.com", "drip.com", "convertkit.com", "klaviyo.com", "beehiiv.com", "substack.com", "substackmail.com",
    "linkedin.com", "facebookmail.com", "noreply.github.com", "accounts.google.com",
)
NOREPLY = ("noreply", "no-reply", "donotreply", "do-not-reply", "notifications", "notification", "mailer-daemon", "postmaster", "bounce", "auto-confirm")
SALES = ("unsubscribe", "limited time", "% off", "free trial", "act now", "exclusive offer", "don't miss", "last chance", "flash sale", "promo code", "coupon", "discount", "webinar", "join us for", "register now")
NEWSLETTER = ("newsletter", "digest", "weekly update", "monthly update", "roundup", "recap", "this week in", "top stories")
RESPONSE = ("?", "please", "could you", "can you", "would you", "let me know", "get back to", "your thoughts", "attached", "invoice", "proposal", "quote", "meeting", "schedule", "call", "urgent", "asap", "priority")
URGENT = ("urgent", "asap", "time-sensitive", "immediate", "critical", "emergency")
MAIL_WEIGHTS = {"bulk": -0.60, "noreply": -0.40, "unsubscribe": -0.50, "sales": -0.15, "newsletter": -0.30, "response": 0.10, "reply": 0.25, "short": 0.10, "direct": 0.15}
MAIL_THRESHOLD, MAIL_HIGH, MAIL_MEDIUM, STATE_DAYS = 0.0, 0.40, 0.10, 7

# Fixed values (procurement).
RELEVANCE = (
    "software", "license", "saas", "subscription", "cloud", "it services", "technology", "microsoft", "adobe", "vmware", "citrix", "oracle", "cisco",
    "dell", "hewlett", "ibm", "sap", "salesforce", "aws", "azure", "google cloud", "enterprise", "renewal", "maintenance", "support agreement",
)
EXCLUDED_TYPES = (
    "notice of sole/single source", "procurement exempt from advertising", "requests for information", "requests for comment",
    "grant or notice of funds availability", "announcement of surplus property disposal", "contractor ads",
)
MIN_DAYS, RELEVANT, BOOST = 7, 0.9, 0.10
STATUSES = ("new", "processed", "quoted", "analyzed", "proposed")
MARGIN, SIMILAR, COMPARABLES = 0.15, 0.1, 10
MATCH_RATIO = 55
SUBFOLDERS = ("Source Documents", "Proposal", "Supporting Docs")
SHOWN_ITEMS = 25
SHEET_ALIASES = {
    "part_number": ("part", "part no", "part number", "sku", "item no", "item number", "item #", "item"),
    "description": ("description", "desc", "product name", "product", "name", "item description", "line item"),
    "quantity": ("quantity", "qty", "amount", "count", "# of licenses", "no. of licenses"),
    "unit": ("unit", "uom", "unit of measure"),
    "vendor": ("vendor", "manufacturer", "mfg", "mfr", "brand"),
    "unit_price": ("unit price", "price", "cost", "rate", "each", "price per unit"),
    "extended_price": ("extended price", "extended", "total", "ext price", "line total", "total price"),
}
TABLE_ALIASES = {
    "part_number": ("part", "partno", "partnumber", "sku", "itemno", "itemnumber", "item"),
    "description": ("description", "desc", "productname", "product", "name", "itemdescription"),
    "quantity": ("quantity", "qty", "amount", "count", "units"),
    "unit": ("unit", "uom", "unitofmeasure", "measure"),
    "vendor": ("vendor", "manufacturer", "mfg", "mfr", "brand", "make"),
    "unit_price": ("unitprice", "price", "cost", "rate", "each"),
    "extended_price": ("extendedprice", "extended", "total", "extprice", "linetotal", "amount"),
}
STOP_WORDS = (
    "the", "a", "an", "and", "or", "for", "of", "to", "in", "on", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "nys", "new", "york", "state", "services", "department",
)
