"""Sinks: the submission and audit tables, JSON and JSON-LD lines, and small single files."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import context

# The submission's columns, in order, and the fields that fill them.
SUBMISSION = {
    "Economy": "economy",
    "Law Name": "law_name",
    "Law Number / Ref": "law_number",
    "Last Amended": "last_amended",
    "Indicator ID": "indicator_id",
    "Article / Section": "article",
    "Discovery Tag": "discovery_tag",
    "Location Reference": "location",
    "Verbatim Snippet": "quote",
    "Mapping Rationale": "rationale",
    "Source URL": "source_url",
    "Confidence": "confidence",
    "Notes": "notes",
}
# What the audit table has besides.
AUDIT_MORE = (
    "clause_id", "jurisdiction", "legal_form", "coverage", "char_start", "char_end", "document_hash", "retrieval_timestamp",
    "review_status", "currency_status", "amended_by", "amendments_incorporated_to", "amendment_text", "source_version",
)


def _field(name: str) -> Column:
    if name == "discovery_tag":  # anything but NEW is known
        return F.when(F.col(name) == "NEW", "NEW").otherwise("KNOWN")
    return F.col(name)


def submission(citations: DataFrame) -> DataFrame:
    return citations.select(*[_field(f).alias(c) for c, f in SUBMISSION.items()])


def audit(citations: DataFrame) -> DataFrame:
    return citations.select(*[_field(f).alias(c) for c, f in SUBMISSION.items()], *AUDIT_MORE)


def json_lines(citations: DataFrame, text: str | None = None, window: int = 200) -> DataFrame:
    """One JSON object a citation, with the surrounding text if `text` names the whole document's."""
    more = [context(F.col(text), F.col("quote"), window).alias("context")] if text else []
    rest = [c for c in citations.columns if c != text]
    return citations.select(F.to_json(F.struct(*rest, *more)).alias("value"))


def jsonld_lines(rows: DataFrame, vocabulary: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(vocabulary).alias("@context"), *rows.columns)).alias("value"))


def labelled(name: Column, replayed: Column) -> Column:
    return F.when(replayed & ~name.startswith("DEMO_"), F.concat(F.lit("DEMO_"), name)).otherwise(name)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV in parts, as a cluster writes it."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def csv_with_bom(rows: DataFrame) -> bytes:
    """One file in memory, with the mark that spreadsheets want; for results of a size that a person reads."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(rows.columns)
    for r in rows.toLocalIterator():
        w.writerow(["" if v is None else v for v in r])
    return out.getvalue().encode("utf-8-sig")
