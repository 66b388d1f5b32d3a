"""Text functions as native column expressions.

Offsets are code points throughout. White space and case are those of ASCII unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is.
LATIN_TOKEN = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
BOUNDARY_FREE_RUN = "[㐀-䶿一-鿿豈-﫿぀-ヿ฀-๿]+"
YEAR = r"\b(1[6-9]\d{2}|20\d{2})\b"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased Latin words, then overlapping bigrams of runs in scripts without spaces."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(BOUNDARY_FREE_RUN), F.lit(0))
    bigrams = F.transform(
        runs,
        lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.concat(latin, F.flatten(bigrams))


def link_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def without_digits(line: Column) -> Column:
    """A line as running headers are compared: lower case, no digits."""
    return F.lower(F.trim(F.regexp_replace(line, "[0-9]+", "")))


def without_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def name_slot(title: Column, most: int = 90) -> Column:
    """The part of a result title before its version or status label."""
    return F.substring(F.trim(F.regexp_replace(title, r"(?is)(current version|repealed|reprint).*$", "")), 1, most)


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def years_conflict(a: Column, b: Column) -> Column:
    """Both name years, and none in common."""
    ya, yb = years(a), years(b)
    return (F.size(ya) > 0) & (F.size(yb) > 0) & ~F.arrays_overlap(ya, yb)


def act_number(masthead: Column) -> Column:
    """The first "Act N" whose N isn't a year; empty if there is none."""
    found = F.regexp_extract_all(masthead, F.lit(r"(?i)\bAct\s+([A-Z]?\d+[A-Z]?)\b"), F.lit(1))
    usable = F.filter(found, lambda x: ~x.rlike(r"^(1[6-9]\d{2}|20\d{2})$"))
    return F.coalesce(F.concat(F.lit("Act "), F.get(usable, 0)), F.lit(""))


def title_key(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(title), r"\[act\s+[a-z]?\d+[a-z]?\]|\(amendment\)", " ")
    bare = F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))
    return F.when(bare != "", F.concat(F.lit("title:"), bare))


def number_key(number: Column) -> Column:
    bare = F.regexp_extract(F.lower(F.trim(number)), r"^(?:act\s+)?([a-z]?\d+[a-z]?)$", 1)
    return F.when((bare != "") & ~bare.rlike(r"^(1[6-9]\d{2}|20\d{2})$"), F.concat(F.lit("act:"), bare))


def candidate_keys(number: Column, title: Column) -> Column:
    """Every key an instrument may be referred to by: its number's and its title's."""
    return F.array_distinct(F.array_compact(F.array(number_key(number), title_key(title))))


def section_of(path: Column) -> Column:
    """The section number of a citation's path; empty where a schedule numbers its own."""
    token = F.regexp_extract(path, r"(?i)\b(?:Section|Sec\.?|S\.?|Regulation|Reg\.?|Article|Art\.?)\s*(\d+[A-Za-z]?)", 1)
    return F.when(path.rlike(r"(?i)^\s*Schedule\b"), "").otherwise(F.coalesce(token, F.lit("")))


def amendment_queries(title: Column, word_tokenised: bool = False) -> Column:
    """What to ask a portal for to find the amendments of a law."""
    core = collapse(F.regexp_replace(F.regexp_replace(F.trim(title), r"(?is)\s*\bAct\b\s*\d.*$", ""), r"(?i)\(amendment\)", ""))
    short = F.concat(core, F.lit(" Amendment"))
    asked = F.array(short) if word_tokenised else F.array(F.concat(core, F.lit(" (Amendment) Act")), short)
    return F.when(F.length(core) >= 3, asked).otherwise(F.array().cast("array<string>"))


def context(text: Column, quote: Column, window: int = 200) -> Column:
    """`window` characters on either side of the first occurrence of `quote`; empty if there is none."""
    at = F.instr(text, quote)
    start = F.greatest(at - window, F.lit(1))
    return F.when((at > 0) & (F.length(quote) > 0), F.substring(text, start, at - start + F.length(quote) + window)).otherwise("")


def copies(words: Column, text: Column, n: int = 6) -> Column:
    """Whether any `n` consecutive `words` stand in `text`, case aside."""
    grams = F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.exists(grams, lambda g: F.contains(F.lower(text), F.lower(g)))


# Words that show a sentence is about a score.
SCORE_TALK = r"(?i)\bscor(?:e|es|ed|ing)\b"


def strip_score_talk(note: Column) -> Column:
    """`note` without the sentences that speak of scores."""
    sentences = F.regexp_extract_all(note, F.lit(r"[^.!?]+[.!?]?"), F.lit(0))
    return F.trim(F.array_join(F.filter(sentences, lambda s: ~s.rlike(SCORE_TALK)), ""))


def joined_notes(*notes: Column) -> Column:
    return F.concat_ws(" | ", *[F.when(F.trim(n) != "", n) for n in notes])


# Numerals of other scripts and what they stand for.
_FULL_WIDTH, _THAI, _ASCII = "０１２３４５６７８９", "๐๑๒๓๔๕๖๗๘๙", "0123456789"
_CN_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_CN_UNITS = {"十": 10, "百": 100, "千": 1000}


def folded_digits(text: Column) -> Column:
    return F.translate(text, _FULL_WIDTH + _THAI, _ASCII * 2)


def numeral(text: Column) -> Column:
    """The number of a provision as ASCII digits, from any of the scripts served; empty if it is none."""
    plain = folded_digits(F.trim(text))
    digit = F.create_map(*[F.lit(x) for kv in _CN_DIGITS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in _CN_UNITS.items() for x in kv])

    def step(s: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        total = F.when(u.isNotNull(), s["total"] + F.greatest(s["held"], F.lit(1)) * u).otherwise(s["total"])
        held = F.when(u.isNotNull(), 0).when(d.isNotNull(), d).otherwise(s["held"])
        return F.struct(total.alias("total"), held.alias("held"))

    value = F.aggregate(
        F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("held")),
        step,
        lambda s: s["total"] + s["held"],
    )
    return F.when(plain.rlike("^[0-9]+$"), plain.cast("decimal(38,0)").cast("string")).otherwise(
        F.when(value > 0, value.cast("string")).otherwise("")
    )


def rendered_search(template: Column, query: Column) -> Column:
    """A portal's search address, with the query percent-encoded."""
    return F.replace(template, F.lit("{query}"), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


# A rationale's length at most, and its wording.
RATIONALE_MOST = 1000


def template_rationale(path: Column, indicator: Column, name: Column, phrases: Column, text: Column, most: int = RATIONALE_MOST) -> Column:
    """Why a clause maps to an indicator, in a fixed wording, with the leading phrases of the indicator that it holds."""
    base = F.concat(F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "This provision").otherwise(path), F.lit(" maps to "), indicator, F.lit(" ("), name, F.lit(")."))
    held = F.filter(phrases, lambda p: (p != "") & F.contains(F.lower(text), F.lower(p)))

    def whole(b: Column) -> Column:
        prefix = F.concat(b, F.lit(" Indicator concept(s) present: "))

        def step(s: Column, p: Column) -> Column:
            longer = F.when(s["said"] == "", F.concat(F.lit("'"), p, F.lit("'"))).otherwise(F.concat(s["said"], F.lit("; '"), p, F.lit("'")))
            fits = s["open"] & (F.length(prefix) + F.length(longer) + 1 <= most)
            return F.struct(F.when(fits, longer).otherwise(s["said"]).alias("said"), fits.alias("open"))

        said = F.aggregate(held, F.struct(F.lit("").alias("said"), F.lit(True).alias("open")), step, lambda s: s["said"])
        return F.when(F.length(b) >= most, F.substring(b, 1, most)).when(said == "", b).otherwise(F.concat(prefix, said, F.lit(".")))

    return let(base, whole)


def lenient_object(content: Column) -> Column:
    """The JSON object in a model's answer, as text: the whole, a fenced one, or from the first brace; null if there is none."""
    plain = F.trim(content)
    fenced = F.regexp_extract(plain, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    tries = F.array(plain, fenced, braced)
    objects = F.filter(tries, lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False)))
    return F.get(objects, 0)


def printed_numbers(value: Column, text: Column) -> Column:
    """Whether a value has numbers and all of them stand in the text."""
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return (F.size(runs) > 0) & F.forall(runs, lambda r: F.contains(text, r))


def year_agrees(number: Column, title: Column) -> Column:
    """False only where both carry a year and the years differ."""
    own = F.regexp_extract(number, r"(?i)\b(?:Act|No\.?)\s*\d+\s+of\s+(\d{4})\b", 1)
    named = F.regexp_extract(F.trim(title), r"\b(1[6-9]\d{2}|20\d{2})$", 1)
    return (own == "") | (named == "") | (own == named)


def principal_number(text: Column) -> Column:
    """The number of the first entry of a printed legislative history; empty if there is none."""
    return collapse(F.regexp_extract(text, r"(?is)LEGISLATIVE\s+HISTORY\b.{0,500}?(?:^|\n)\s*1\.\s*(Act\s+\d+\s+of\s+\d{4})\b", 1))


# How portals and uploads disfigure a law's name.
_SHELL = r"(?is)\s+Current version as at\b.*$"
_EXTENSION = r"(?i)\.(?:pdf|docx?|html?|txt)\s*$"
_UPLOAD = (
    r"(?i)\s*\((?:\d+|final|ku|bi|dalam\s+talian[^)]*|reprint[^)]*|[\d.\s/]+)\)"
    r"|\s*_(?:unlocked|online|final|ori|bi|ku)\b"
    r"|\s*\b(?:ori|final|unlocked)\s*$"
    r"|\s*\bas\s+at\s+\d{1,2}\s+\w+\s+\d{4}\s*$"
    r"|\s*\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\s*$"
    r"|^\s*\d{1,2}\.\s+"
    r"|^\s*\d{8}_"
)
_LAW_END = (
    r"(?i)\b(?:act|regulations?|rules|order|code|ordinance|enactment|decree|bill|guidelines?|advisory|notice|standard)\b"
    r"[\s,]*(?:\(?(?:19|20)\d{2}\)?)?\s*$"
)
_BARE_NUMBER = r"(?i)^act\s+[a-z]?\d+[a-z]?$"
UPLOAD_ROUNDS = 5  # marks that are taken off one after the other


def law_name(title: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(title, F.lit("")), _SHELL, ""))


def is_file_name(name: Column) -> Column:
    return name.rlike(_EXTENSION) | (name.rlike(_UPLOAD) & ~name.rlike(_LAW_END))


def masthead_title(text: Column, lines: int = 24) -> Column:
    """The title under a line that is an act's number, of one letter case, up to its year; empty if there is none."""
    head = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != ""), 1, lines + 4)
    at = F.array_position(F.transform(F.slice(head, 1, lines), lambda x: x.rlike(_BARE_NUMBER)), True)
    after = F.when(at > 0, F.slice(head, (at + 1).cast("int"), F.lit(4))).otherwise(F.array().cast("array<string>"))
    title = r"\b(?:ACT|ENACTMENT|ORDINANCE)\s+(?:19|20)\d{2}$"

    def step(s: Column, x: Column) -> Column:
        uniform = ((x == F.upper(x)) | (x == F.lower(x))) & (F.upper(x) != F.lower(x))
        goes_on = s["open"] & uniform
        joined = F.when(goes_on, F.trim(F.concat(s["said"], F.lit(" "), x))).otherwise(s["said"])
        done = goes_on & joined.rlike("(?i)" + title)
        return F.struct(joined.alias("said"), (goes_on & ~done).alias("open"), F.when(done, joined).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit("").alias("said"), F.lit(True).alias("open"), F.lit("").alias("found"))
    return F.initcap(F.lower(collapse(F.aggregate(after, start, step, lambda s: s["found"]))))


def resolved_name(title: Column, text: Column) -> Column:
    """A portal's title if it names a law; else the masthead's; else the title without its upload marks."""
    name = law_name(title)
    cleaned = F.regexp_replace(name, _EXTENSION, "")
    for _ in range(UPLOAD_ROUNDS):
        cleaned = F.btrim(F.regexp_replace(cleaned, _UPLOAD, ""), F.lit(" -_,."))
    cleaned = F.btrim(collapse(cleaned), F.lit(" -_,."))
    printed = masthead_title(text)
    nameless = is_file_name(name) | name.rlike(_BARE_NUMBER)
    return (
        F.when(~nameless, name).when(printed != "", printed).when(name.rlike(_BARE_NUMBER), name).when(cleaned != "", cleaned).otherwise(name)
    )


CLAUSE_MOST = 1200


def clause_prompt(catalogue: Column, path: Column, text: Column, most: int = CLAUSE_MOST) -> Column:
    """The indicator catalogue, which all prompts share, then the clause, shortened."""
    flat = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(" …"))).otherwise(flat)
    return F.concat(F.lit("INDICATORS:\n"), catalogue, F.lit("\n\nCLAUSE ("), path, F.lit("):\n"), short)


def fingerprint(system: Column, rendered: Column) -> Column:
    """Changes with any word or order of a prompt."""
    return F.sha2(F.concat(system, F.lit("\x02"), rendered).cast("binary"), 256)


# What a regulator's list of publications puts before a title.
_GUIDANCE = r"^(?:Advisory Guidelines|Practical Guidance|Publications?|Templates?|Training Courses|Tools?|Guides?)?\s*\d{1,2}\s+[A-Za-z]{3,}\s+\d{4}\s+"


def guidance_title(title: Column) -> Column:
    """A title without the category and date before it; as it is where nothing else is left."""
    flat = collapse(title)
    bare = F.trim(F.regexp_replace(flat, _GUIDANCE, ""))
    return F.when(bare != "", bare).otherwise(flat)


def printable(text: Column, placeholder: str = "?") -> Column:
    """For display on a terminal of ASCII only; what it can't show is replaced."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", placeholder)


def act_core(title: Column) -> Column:
    """What names an act: all before the word Act; empty where it has none before it."""
    return F.when(title.rlike(r"\bAct\b"), collapse(F.regexp_replace(title, r"(?s)\bAct\b.*$", ""))).otherwise(collapse(title))


def act_tokens(name: Column) -> Column:
    """The numbers a name gives its act, as act709 or acta1727; a year is none."""
    low = F.lower(name)
    numbered = F.filter(F.regexp_extract_all(low, F.lit(r"act\s*([a-z]?\d+)"), F.lit(1)), lambda n: ~n.rlike(r"^(19|20)\d{2}$"))
    amending = F.regexp_extract_all(low, F.lit(r"\b(a\d{3,4})\b"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(numbered, amending), lambda n: F.concat(F.lit("act"), n)))


#: A rule of the law classifier: its law, the act tokens that name it, words that must all be there, words of which none may.
LawRule = tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]


def classified(name: Column, rules: list[LawRule]) -> Column:
    """The first rule's law that a name's act numbers or words fit; null for none. The table becomes one chain of conditions."""
    low, found = F.lower(name), act_tokens(name)
    chain = None
    for law, acts, words, never in rules:
        fits = F.arrays_overlap(found, F.array(*[F.lit(a) for a in acts])) if acts else F.lit(False)
        if words:
            has = F.lit(True)
            for w in words:
                has = has & F.contains(low, F.lit(w))
            for w in never:
                has = has & ~F.contains(low, F.lit(w))
            fits = fits | has
        chain = F.when(fits, law) if chain is None else chain.when(fits, law)
    return F.lit(None).cast("string") if chain is None else chain


SYNONYMS_MOST, SYNONYM_LONGEST = 12, 80


def synonyms(content: Column) -> Column:
    """The search terms in a model's answer ({"terms": [...]}): trimmed, each once whatever its case, at most twelve and none too long."""
    told = F.from_json(F.get_json_object(lenient_object(content), "$.terms"), "array<string>")
    tidy = F.filter(F.transform(F.coalesce(told, F.array().cast("array<string>")), lambda t: collapse(t)), lambda t: (t != "") & (F.length(t) <= SYNONYM_LONGEST))
    first = F.filter(tidy, lambda t, i: F.array_position(F.transform(tidy, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, SYNONYMS_MOST)
