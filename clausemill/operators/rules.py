"""Predicates on instruments, clauses, links and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# How portals and titles state that an instrument is no law, or no law yet.
PORTAL_REPEALED = ("repeal", "ceased", "spent", "expired", "revoked", "superseded")
PORTAL_DRAFT = ("not yet in force", "notinforce", "not in force", "before parliament")
TITLE_REPEALED = r"(?i)\(\s*(?:repealed|spent|ceased|revoked)\b"
TITLE_DRAFT = r"(?i)\b(?:exposure draft|draft (?:bill|for consultation))\b|\bbill\s+\d{1,4}\s+of\s+\d{4}\b|\(\s*draft\b"
TEXT_REPEALED = r"(?i)\bthis\s+(?:act|regulation|ordinance|decree|law)\s+(?:is|has been|was)\s+repealed\b"
TEXT_DRAFT = r"(?i)\bexposure draft\b|\[\s*draft[^\]]*\]|\bfor public consultation\b"
HEAD_CHARACTERS = 1500

# Markers of the boundaries between indicators.
RETENTION_MINIMUM = (
    "at least", "minimum", "not less than", "no less than", "for a period of",
    "for a minimum", "must be kept for", "must be retained for", "must keep",
    "must retain", "shall keep", "shall retain", "retain the", "retention period of",
)
RETENTION_LIMIT = (
    "cease to retain", "cease retaining", "no longer than", "not longer than",
    "not be kept longer", "shall not be kept", "must not be kept", "as soon as",
    "no longer necessary", "longer than is necessary", "longer than necessary",
)
TRANSFER_CONDITION = (
    "comparable to the protection", "comparable level of protection",
    "appropriate safeguards", "adequate level of protection", "adequacy",
    "appropriate protection", "with the consent", "consent of the individual",
    "the individual consents", "given consent", "prescribed", "prescribed conditions",
    "subject to the conditions", "binding corporate rules", "standard contractual",
    "approved by", "specified by the minister", "place as specified", "as specified by",
)
TRANSFER_BAN = (
    "must not transfer", "shall not transfer", "may not transfer", "prohibited from transferring",
    "ban on transfer", "must not be transferred", "may not be transferred",
    "must be held", "must be stored", "stored within", "held within", "processed within",
    "processed locally", "local processing", "must not be held or processed outside",
    "must not be processed outside", "only be held", "only be processed",
    "must not hold", "must not process", "not hold or process",
)
CROSS_BORDER = (
    r"\btransfer|\boutside\b|\babroad\b|\boverseas\b|cross-?border"
    r"|another (?:country|territory|jurisdiction)|foreign (?:country|jurisdiction)"
)

# Links that are a portal's furniture.
CHROME = (
    "login", "signin", "sign-in", "register", "logout", "contact", "about",
    "sitemap", "privacy-policy", "terms", "feedback", "subscribe", "rss",
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com",
    "instagram.com", "javascript:", "mailto:", "tel:",
    "/browse/", "/help/", "/search/advanced", "/search/content",
    "frequently-accessed", "acts-supp", "act-rev", "/sso-guide",
    "my collections", "revised editions", "acts supplement",
)
NAVIGATION = (
    "search", "advanced search", "see all", "see all...", "see more", "more",
    "ordinance", "ordinances", "translated", "translation", "top hit", "top hits",
    "top hit (weekly)", "top hit (monthly)", "home", "back", "next", "previous",
    "all", "view all", "browse", "download", "print", "help",
)
INSTRUMENT_MARKERS = ("act", "legislation", "statute", "law", "/cap", "bill", "regulation", "ordinance", "gazette", "decree", "code")

# Headings that open no operative provision.
BOILERPLATE_HEAD = r"(?i)^(?:short title|citation|commencement|interpretation|definitions?|objects?|purpose)\b"
LEADING_NUMBER = r"^\s*\d+[A-Z]?\s*[.—\-]*\s*"


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def lifecycle(title: Column, text: Column, portal_status: Column | None = None, in_force: Column | None = None) -> Column:
    """REPEALED, DRAFT, IN_FORCE or UNKNOWN; a portal's word goes before the title's, that before the text's."""
    label = F.lower(F.coalesce(portal_status, F.lit(""))) if portal_status is not None else F.lit("")
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARACTERS)
    title = F.coalesce(title, F.lit(""))
    made = F.when(has_any(label, PORTAL_DRAFT), "DRAFT").when(has_any(label, PORTAL_REPEALED), "REPEALED")
    if in_force is not None:
        made = made.when(in_force, "IN_FORCE")
    return (
        made.when(title.rlike(TITLE_REPEALED), "REPEALED")
        .when(title.rlike(TITLE_DRAFT), "DRAFT")
        .when(head.rlike(TEXT_REPEALED), "REPEALED")
        .when(head.rlike(TEXT_DRAFT), "DRAFT")
        .otherwise("UNKNOWN")
    )


def merged_status(first: Column, second: Column) -> Column:
    return F.when(F.coalesce(first, F.lit("UNKNOWN")) != "UNKNOWN", first).otherwise(F.coalesce(second, F.lit("UNKNOWN")))


def enforced(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("UNKNOWN")).isin("REPEALED", "DRAFT")


def admits(indicator: Column, text: Column) -> Column:
    """Whether the boundary rule of an indicator, if it has one, lets a clause through."""
    t = F.lower(collapse(text))
    abroad = t.rlike(CROSS_BORDER)
    condition = has_any(t, TRANSFER_CONDITION)
    return (
        F.when(indicator == "7.3", ~has_any(t, RETENTION_LIMIT) | has_any(t, RETENTION_MINIMUM))
        .when(indicator == "6.1", ~abroad | ~condition)
        .when(indicator == "6.4", ~abroad | ~has_any(t, TRANSFER_BAN) | condition)
        .otherwise(True)
    )


def boilerplate(text: Column) -> Column:
    head = F.substring(F.regexp_replace(F.ltrim(text), LEADING_NUMBER, ""), 1, 48)
    return head.rlike(BOILERPLATE_HEAD)


def chrome(url: Column, label: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", url, label)), CHROME)


def navigation_label(label: Column) -> Column:
    whole = F.regexp_replace(F.lower(collapse(F.coalesce(label, F.lit("")))), r"\.+$", "")
    return whole.isin([w.rstrip(".") for w in NAVIGATION])


def page_outcome(html: Column, has_results: Column) -> Column:
    """RESULTS, EMPTY, BLOCKED or UNRENDERED."""
    head = F.lower(F.substring(html, 1, 4096))
    return (
        F.when(F.trim(F.coalesce(html, F.lit(""))) == "", "UNRENDERED")
        .when(head.rlike("access denied|request unsuccessful|captcha|are you a robot|error 403|403 forbidden"), "BLOCKED")
        .when(has_results, "RESULTS")
        .when(head.rlike(r"<body[^>]*>\s*</body>"), "UNRENDERED")
        .otherwise("EMPTY")
    )


# Function words by which recognised text is legible.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "for", "or", "by", "shall", "be", "any", "is", "under", "with", "that", "this", "on", "as")


def legible(text: Column, least_words: int = 120, least_share: float = 0.10) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    known = F.size(F.filter(words, lambda w: w.isin(list(FUNCTION_WORDS))))
    return (F.size(words) >= least_words) & (known >= least_share * F.size(words))


def coalesced_verdict(contents: Column, title: Column) -> Column:
    """Hits from a table of contents overrule those from the title, even if there are none."""
    return F.size(F.coalesce(contents, title)) > 0


def or_whole(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, or all rows if none does (decided in the same job)."""
    met = df.withColumn("_met", F.coalesce(condition, F.lit(False)))
    some = met.agg(F.coalesce(F.bool_or("_met"), F.lit(False)).alias("_some"))
    return met.crossJoin(F.broadcast(some)).where(F.col("_met") | ~F.col("_some")).drop("_met", "_some")


def after_floor(year: Column, floor: Column) -> Column:
    """Unknown years and unknown floors let a candidate through."""
    return ~(F.coalesce(floor.isNotNull() & year.isNotNull() & (year <= floor), F.lit(False)))


def web_address(url: Column) -> Column:
    return F.lower(F.trim(url)).rlike("^https?://")


def answered(status: Column, text: Column) -> Column:
    """Whether a fetch gave a text: a status of success, and something in it."""
    return F.coalesce(status.between(200, 299) & (F.length(text) > 0), F.lit(False))


# How trade agreements are named; they bind states and are no law to cite.
AGREEMENT = ("agreement", "partnership", "cptpp", "rcep", "aanzfta", "depa", "ksdpa", "free trade", "cbpr")
# Indicators that only a law about data can carry; the others almost any statute might.
FRAMEWORK = ("P6-I1", "P6-I2", "P6-I3", "P6-I4", "P7-I1", "P7-I2", "P7-I4")
# Marks of another jurisdiction's law, and names that name nothing.
FOREIGN = r"(?i)\(EU\)|European|\bGDPR\b|Maltese|British|United Kingdom"
JUNK = ("act", "the act", "amendment act", "privacy act amendment act")
LEAST_NAME = 8


def trade_agreement(name: Column) -> Column:
    return has_any(F.lower(name), AGREEMENT)


def horizontal_only(hits: Column, framework: tuple[str, ...] = FRAMEWORK) -> Column:
    """Whether a law's hits are of horizontal duties alone, so that its contents decide."""
    return F.coalesce((F.size(hits) > 0) & ~F.arrays_overlap(hits, F.array(*[F.lit(x) for x in framework])), F.lit(False))


def tidy_names(names: DataFrame, by: list[str], name: str = "name", order: str = "ord") -> DataFrame:
    """Laws' names without lead-ins, junk and other jurisdictions' laws, each once whatever its case: the first spelling."""
    bare = names.withColumn(name, F.trim(F.regexp_replace(F.trim(name), r"(?i)^(the|a|via|under|and)\s+", "")))
    low = F.lower(F.col(name))
    kept = bare.where((F.length(name) >= LEAST_NAME) & ~low.isin(*JUNK) & ~F.col(name).rlike(FOREIGN))
    first = kept.groupBy(*by, low.alias("_low")).agg(F.min(F.struct(order, name)).alias("f"))
    return first.select(*by, F.col(f"f.`{name}`").alias(name), F.col(f"f.`{order}`").alias(order))
