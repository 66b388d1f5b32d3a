"""Whether a cited provision is current: amendment chains, as-of joins, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import candidate_keys, collapse

# Where an instrument says what it amends and up to when it has been amended.
YEAR = r"(1[6-9]\d{2}|20\d{2})"
INCORPORATES = (
    rf"(?i)incorporating\s+(?:all\s+)?amendments?\b[^.\n]*?{YEAR}",
    rf"(?i)\bas at\b[^.\n]*?{YEAR}",
    rf"(?i)\brevised\s*[—–-]\s*{YEAR}",
    rf"(?i)\brevised\s+edition[,\s]*{YEAR}",
    rf"(?i)\brevised\s+up\s+to\b[^.\n]{{0,30}}?{YEAR}",
    rf"(?i)\bamendments?\s+incorporated\b[^.\n]*?{YEAR}",
    rf"(?i)includes\s+amendments?\b[^\n]*?{YEAR}",
)
TO_AMEND = r"(?i)to amend the\s+(.{3,80}?Act,?\s+\d{4})"
LONG_TITLE = r"(?i)\bAn Act\b[^.\n]{0,40}?\bto amend\b"
PRINCIPAL = r"(?i)(.{3,80}?Act,?\s+\d{4})\s*\[Act\s+([A-Z]?\d+[A-Z]?)\][^.]{0,80}?principal\s+Act"
NOT_COMMENCED = r"(?i)comes?\s+into\s+(?:operation|force)\s+on\s+a\s+date\s+to\s+be\s+appointed"
SECTION_OP = r"(?i)section\s+(\d+[A-Z]?)\s+of\s+the\s+principal\s+Act\s+is\s+(amended|deleted|repealed|substituted)"
INSERTION = r"(?i)inserting\s+(?:after|before)\s+section\s+(\d+[A-Z]?)"
SUBSTITUTION = r"(?i)\b(?:and\s+the\s+following|and\s+(?:there\s+(?:is|are)\s+)?(?:substituted|replaced)|in\s+substitution|substituted\s+there(?:for|of))"
DEFINITION = r"(?i)\b(interpretation|definition|principle)s?\b"
RENAME = r"(?is)substitut\w*\s+for\s+the\s+(?:word|expression)s?\s+[\"“”]([^\"“”]+)[\"“”][^.]*?wherever\s+(?:appearing|they\s+appear|it\s+appears)\b(?:[^.]*?the\s+(?:word|expression)s?\s+[\"“”]([^\"“”]+)[\"“”])?"
HEAD = 4000
PRECEDENCE = ("corpus", "portal", "registry")


def ends(text: Column) -> Column:
    """Masthead and end notes."""
    return F.when(F.length(text) <= 2 * HEAD, text).otherwise(F.concat(F.substring(text, 1, HEAD), F.lit("\n"), F.substring(text, -HEAD, HEAD)))


def incorporated_to(text: Column) -> Column:
    """The latest year that a text says it has been amended up to; null if it says none."""
    found = F.flatten(F.array(*[F.regexp_extract_all(ends(text), F.lit(p), F.lit(1)) for p in INCORPORATES]))
    return F.array_max(F.transform(found, lambda y: y.cast("int")))


def version_kind(text: Column) -> Column:
    head = F.substring(text, 1, HEAD)
    amends = head.rlike(TO_AMEND) | head.rlike(PRINCIPAL) | head.rlike(LONG_TITLE)
    return F.when(amends, "AMENDMENT_DELTA").when(incorporated_to(text).isNotNull(), "CONSOLIDATED").otherwise("ORIGINAL")


def amends_target(text: Column) -> Column:
    """struct(number, title) of the principal that an amending text names; null if it names none."""
    head = ends(text)
    number = F.regexp_extract(head, PRINCIPAL, 2)
    by_number = F.struct(F.concat(F.lit("Act "), number).alias("number"), F.trim(F.regexp_extract(head, PRINCIPAL, 1)).alias("title"))
    by_title = F.struct(F.lit("").alias("number"), F.trim(F.regexp_extract(head, TO_AMEND, 1)).alias("title"))
    return F.when(number != "", by_number).when(F.regexp_extract(head, TO_AMEND, 1) != "", by_title)


def commenced(text: Column) -> Column:
    return ~F.substring(text, 1, HEAD).rlike(NOT_COMMENCED)


def instructions(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, ord, kind, op, target_section, old_term, new_term, raw): an amending text's instructions."""
    t = F.col(text)
    none = F.lit("")
    # each operation with the text up to the next one
    pieces = F.split(t, rf"(?={SECTION_OP})")
    sections = F.transform(
        F.filter(pieces, lambda p: p.rlike(f"^{SECTION_OP}")),
        lambda p: F.struct(
            F.lit(2).alias("part"), F.regexp_extract(p, SECTION_OP, 1).alias("target_section"),
            F.lower(F.regexp_extract(p, SECTION_OP, 2)).alias("verb"), collapse(F.regexp_extract(p, SECTION_OP, 0)).alias("raw"),
            F.substring(p, 1, 240).rlike(DEFINITION).alias("defines"),
            F.substring(F.regexp_replace(p, f"^{SECTION_OP}", ""), 1, 160).rlike(SUBSTITUTION).alias("replaces"),
            none.alias("old_term"), none.alias("new_term"),
        ),
    )
    renames = F.transform(
        F.regexp_extract_all(t, F.lit(RENAME), F.lit(0)),
        lambda p: F.struct(
            F.lit(1).alias("part"), none.alias("target_section"), F.lit("rename").alias("verb"), collapse(p).alias("raw"), F.lit(False).alias("defines"),
            F.lit(False).alias("replaces"), F.trim(F.regexp_extract(p, RENAME, 1)).alias("old_term"), F.trim(F.regexp_extract(p, RENAME, 2)).alias("new_term"),
        ),
    )
    inserts = F.transform(
        F.regexp_extract_all(t, F.lit(INSERTION), F.lit(0)),
        lambda p: F.struct(
            F.lit(3).alias("part"), F.regexp_extract(p, INSERTION, 1).alias("target_section"), F.lit("insert").alias("verb"), collapse(p).alias("raw"),
            F.lit(False).alias("defines"), F.lit(False).alias("replaces"), none.alias("old_term"), none.alias("new_term"),
        ),
    )
    rows = texts.select(key, F.posexplode(F.concat(renames, sections, inserts)).alias("ord", "i"))
    removed = F.col("i.verb").isin("deleted", "repealed")
    op = (
        F.when(F.col("i.part") == 1, "rename").when(F.col("i.part") == 3, "insert").when(removed & ~F.col("i.replaces"), "delete")
        .when(removed | (F.col("i.verb") == "substituted"), "substitute").otherwise("amend")
    )
    kind = F.when(F.col("i.part") == 1, "GLOBAL_RENAME").when(F.col("i.defines"), "DEFINITION_OR_PRINCIPLE").otherwise("SECTION_OP")
    return rows.select(key, "ord", kind.alias("kind"), op.alias("op"), "i.target_section", "i.old_term", "i.new_term", "i.raw")


def chain(events: DataFrame) -> DataFrame:
    """Events (key, year, amending_id, title, detected_by, ord) without repeats: in a year, an event without an id is one of those that have one."""
    rank = F.coalesce(*[F.when(F.col("detected_by") == d, F.lit(i)) for i, d in enumerate(PRECEDENCE)], F.lit(len(PRECEDENCE)))
    one = events.groupBy("key", "year", "amending_id").agg(F.min(F.struct(rank.alias("rank"), "ord", "title", "detected_by")).alias("e"))
    named = F.max(F.col("amending_id") != "").over(Window.partitionBy("key", "year"))
    kept = one.withColumn("_named", named).where(~F.col("_named") | (F.col("amending_id") != ""))
    return kept.select("key", "year", "amending_id", F.col("e.title").alias("title"), F.col("e.detected_by").alias("detected_by"))


def missed(instruments: DataFrame, events: DataFrame) -> DataFrame:
    """Of instruments (key, cutoff): how many events lie after the cutoff (all, where there is none), and which years."""
    later = instruments.join(events, "key", "left").withColumn("_later", F.col("year") > F.coalesce("cutoff", F.lit(-1)))
    return later.groupBy("key", "cutoff").agg(
        F.count(F.col("year")).alias("n_events"),
        F.count_if("_later").alias("n_missed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_later"), F.col("year").cast("string")))), ",").alias("missed_years"),
    )


def document_status(n_events: Column, n_missed: Column, kind: Column) -> Column:
    return F.when(n_missed > 0, "STALE_RISK").when((n_events > 0) | (kind == "CONSOLIDATED"), "CURRENT").otherwise("UNKNOWN")


def adjudicated(citations: DataFrame, ops: DataFrame) -> DataFrame:
    """Citations (citation, key, section, commenced) against instructions (key, target_section, op, raw, ord).

    A deletion goes before an amendment, that before none; without a section there is no verdict.
    """
    texts = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "raw")))), lambda x: x["raw"]), "; ")
    # a section's instructions are one row before citations meet them, however many cite it
    by_section = ops.where("target_section <> ''").groupBy("key", F.col("target_section").alias("section")).agg(
        F.bool_or(F.col("op") == "delete").alias("gone"),
        F.bool_or(F.col("op").isin("amend", "substitute", "insert")).alias("changed"),
        texts(F.col("op") == "delete").alias("gone_text"),
        texts(F.col("op").isNotNull()).alias("all_text"),
    )
    flags = citations.join(by_section, ["key", "section"], "left").na.fill(False, ["gone", "changed"])
    status = (
        F.when(F.col("section") == "", F.lit(None)).when(F.col("gone") & F.col("commenced"), "REPEALED").when(F.col("gone"), "STALE_RISK")
        .when(F.col("changed"), "AMENDED").otherwise("CURRENT")
    )
    text = F.when(F.col("section") == "", "").when(F.col("gone"), F.col("gone_text")).when(F.col("changed"), F.col("all_text")).otherwise("")
    return flags.select("citation", "key", "section", status.alias("status"), text.alias("amendment_text"))


def renamed(citations: DataFrame, ops: DataFrame, label: Column) -> DataFrame:
    """Citations (citation, key, quote) with `rename_note`: the first of their law's renames whose old term the quote has, case aside.

    Of a law's renames of one term only the first can be told, so what travels to its citations, as one row, has a rename for
    each old term. A quote is lowered once, and searched until a term is found.
    """
    note = F.concat(F.lit('term "'), F.col("old_term"), F.lit('" renamed to "'), F.col("new_term"), F.lit('" by '), label)
    firsts = ops.where("kind = 'GLOBAL_RENAME' and old_term <> ''").groupBy("key", F.lower("old_term").alias("old")).agg(F.min(F.struct("ord", note.alias("note"))).alias("_first"))
    renames = firsts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_first.ord", "old", "_first.note"))).alias("_renames"))
    out = citations.join(renames, "key", "left")
    none = F.lit(None).cast(out.schema["_renames"].dataType.elementType)

    def held(text: Column) -> Column:
        return F.aggregate("_renames", none, lambda found, r: F.coalesce(found, F.when(F.contains(text, r["old"]), r)))

    lowered = F.array(F.lower(F.coalesce("quote", F.lit(""))))  # by a lambda, so that it isn't evaluated for each term
    return out.withColumn("rename_note", F.coalesce(F.get(F.transform(lowered, held), 0)["note"], F.lit(""))).drop("_renames")


def principals(documents: DataFrame) -> DataFrame:
    """What amending documents amend: (amending_id, key, principal_id, commenced), from documents (document_id, number, title, text).

    An amending document names its principal in its own masthead; documents meet by any of the keys that either has.
    `principal_id` is null where the principal isn't among them.
    """
    text = F.col("text")
    named = documents.withColumn("_kind", version_kind(text)).withColumn("_target", amends_target(text))
    amending = named.where("_kind = 'AMENDMENT_DELTA' and _target is not null").select(
        F.col("document_id").alias("amending_id"), F.explode(candidate_keys(F.col("_target.number"), F.col("_target.title"))).alias("key"), commenced(text).alias("commenced")
    )
    own = named.where("_kind <> 'AMENDMENT_DELTA'").select(F.col("document_id").alias("principal_id"), F.explode(candidate_keys(F.col("number"), F.col("title"))).alias("key"))
    return amending.join(own, "key", "left").select("amending_id", "key", "principal_id", "commenced")


def affected(ops: DataFrame) -> DataFrame:
    """By key: the sections that instructions touch, in order, and whether any renames a term throughout."""
    return ops.groupBy("key").agg(
        F.array_sort(F.array_compact(F.collect_set(F.when(F.col("target_section") != "", F.col("target_section"))))).alias("sections"),
        F.bool_or(F.col("kind") == "GLOBAL_RENAME").alias("renames"),
    )


def verified_instructions(told: DataFrame, parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """A model's instructions (key, ord, kind, op, target_section, old_term, new_term, raw) that its source bears out; the parsed ones where none is left.

    `texts` is (key, text). Evidence must stand in the text; an operation on a section must name one; a deletion, which removes
    a citation, must quote its section.
    """
    flat = collapse(F.lower(F.col("text")))
    met = told.join(texts.select("key", flat.alias("_text")), "key")
    quoted = F.contains("_text", collapse(F.lower(F.col("raw")))) & (F.trim("raw") != "")
    section = F.col("target_section")
    named = (F.col("kind") == "GLOBAL_RENAME") | (section != "")
    proven = (F.col("op") != "delete") | F.rlike(F.lower("raw"), F.concat(F.lit(r"section\s+"), F.lower(section), F.lit(r"\b")))
    good = met.where(quoted & named & proven).drop("_text")
    return good.select(*parsed.columns).unionByName(parsed.join(good.select("key").distinct(), "key", "left_anti").select(*parsed.columns))


def events_for(citations: DataFrame, events: DataFrame) -> DataFrame:
    """Events (citation, year, amending_id) that any of a citation's keys (array `keys`) refers to, once each."""
    asked = citations.select("citation", F.explode(F.array_distinct("keys")).alias("key"))
    return asked.join(events, "key").select("citation", "year", "amending_id").distinct()
