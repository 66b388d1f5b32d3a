"""Files as if they had been fetched: local ingest, the contents of a statute, books, and pages where a parser is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.rules import legible
from ..session import ship
from .trackers import SIGNAL


def ingested(spark: SparkSession, path: str, iso: str, portal: str, source_type: str = "primary", content_type: str = "application/pdf", pattern: str = "*") -> DataFrame:
    """Raw documents of the files under `path`, by content: what a file's bytes are is what it is, wherever it lies.

    Read by Spark, so the path may be in any store that it reads; of files with the same bytes the first by path stays.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = files.select(
        keys.document_id(F.lit(iso), F.col("content")).alias("document_id"), F.col("path").alias("source_url"), F.col("modificationTime").alias("retrieval_timestamp"),
        F.lit(200).alias("http_status"), keys.content_hash(F.col("content")).alias("sha256"), F.lit(content_type).alias("content_type"), F.lit(portal).alias("portal_name"),
        F.lit(iso).alias("jurisdiction"), F.lit(source_type).alias("source_type"), name.alias("title"), "content",
    )
    first = rows.groupBy("sha256").agg(F.min("source_url").alias("source_url"))
    return rows.join(first, ["sha256", "source_url"], "left_semi")


#: Gives the texts of a document's pages, in order.
Parser = Callable[[bytes], list[str]]


def installed_parser() -> Parser:
    """A PDF parser if this Python has one; it is no part of the engine."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF parser is installed; pass one that gives the texts of a document's pages") from e
    import io

    return lambda body: [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(body)).pages]


def text_pages(documents: DataFrame, parser: Callable[[], Parser] = installed_parser, body: str = "content") -> DataFrame:
    """(document_id, page_number, text, reason): a row a page; one without number says why a document gave none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b["document_id"], b[body]):
                try:
                    rows += [(doc, k, t, None) for k, t in enumerate(parse(bytes(data)), 1)]
                except Exception as e:  # noqa: BLE001  a broken file must not take the others along
                    rows.append((doc, None, None, f"parse-{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "reason"]).astype({"page_number": "Int32"})

    ship(documents.sparkSession)
    return documents.select("document_id", body).mapInPandas(run, "document_id string, page_number int, text string, reason string")


# Where a statute's contents begin, and how much of them a judge reads.
CONTENTS_HEAD = "ARRANGEMENTOFSECTIONS"
BEFORE_CONTENTS, CONTENTS_MOST, LEAST_TEXT = 200, 12_000, 300
SIZE_CAP = 90_000_000


def contents(url: Column, status: Column, size: Column, magic: Column, text: Column, by_ocr: Column) -> Column:
    """struct(text, reason): a statute's table of contents from its front matter, or why there is none.

    The heading is looked for without spaces, which recognition drops. Noise must not reach a judge, who would find
    nothing in it: an unreadable law is kept, with its reason.
    """
    flat = F.replace(F.upper(text), F.lit(" "), F.lit(""))
    at = F.instr(flat, CONTENTS_HEAD)
    start = F.greatest(at - BEFORE_CONTENTS, F.lit(1))
    found = F.when(at > 0, F.substring(text, start, at - start + CONTENTS_MOST)).otherwise(F.substring(text, 1, CONTENTS_MOST))
    reason = (
        F.when(F.coalesce(url, F.lit("")) == "", "no-pdf-link").when(status != 200, F.concat(F.lit("http-"), status.cast("string")))
        .when(size > SIZE_CAP, "over-size-cap").when(magic != "%PDF", "not-a-pdf")
        .when(F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_TEXT, "no-text-layer").when(by_ocr & ~legible(text), "ocr-illegible").otherwise("")
    )
    return F.struct(F.when(reason == "", found).otherwise("").alias("text"), reason.alias("reason"))


def inner_body(page: Column) -> Column:
    """What is inside a book page's body, its bytes read as UTF-8 whatever it says of itself; the whole page where it has no body."""
    text = F.decode(page, "UTF-8") if not isinstance(page, str) else F.decode(F.col(page), "UTF-8")
    found = F.regexp_extract(text, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    return F.when(text.rlike(r"(?is)<body\b[^>]*>.*</body\s*>"), found).otherwise(text)


def _yaml(spark: SparkSession, path: str) -> dict:
    """A small file that Spark reads, as it may lie in a store of its own."""
    rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    return yaml.safe_load(bytes(rows[0]["content"]).decode("utf-8")) or {} if rows else {}


SECONDARY = "key string, name string, url string, pillars array<int>, indicators array<string>, tier int, notes string"


def secondary_sources(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of secondary sources."""
    rows = [
        (str(s["key"]), str(s["name"]), str(s.get("url") or ""), [int(p) for p in s.get("pillars") or []], [str(i) for i in s.get("indicators") or []], int(s.get("tier", 1)), str(s.get("notes") or ""))
        for s in _yaml(spark, path).get("sources") or []
    ]
    return spark.createDataFrame(rows, SECONDARY)


def restrictiveness(spark: SparkSession, path: str, indicator: str, name: str, root: str = "values") -> DataFrame:
    """Signals from a snapshot file, a map of economies to measures to values: yes where a value is above zero."""
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("t"))
    values = text.select(F.from_json(F.get_json_object("t", f"$.{root}"), "map<string,map<string,double>>").alias("m"))
    cells = values.select(F.explode("m").alias("economy", "by")).select("economy", F.explode("by").alias("measure", "v"))
    said = F.when(F.col("v") > 0, "yes").otherwise("no")
    note = F.concat(F.lit(f"{name}: "), F.col("measure"), F.lit(" = "), F.col("v").cast("string"))
    out = cells.select(F.upper("economy").alias("economy"), F.lit(indicator).alias("indicator"), F.lit(name).alias("source"), said.alias("presence"), F.lit("").alias("law"), note.alias("note"))
    return out.select(*[c.split()[0] for c in SIGNAL.split(", ")])


def prose(blocks: DataFrame, page: str, says: str, least: int, blocks_most: int, most: int, also: str | None = None) -> DataFrame:
    """(page, text): the first blocks of a page (page, block_no, text) that say something, joined and cut at `most` characters."""
    wanted = (F.length("text") > least) & F.col("text").rlike(says)
    if also:
        wanted = wanted & F.col("text").rlike(also)
    listed = F.slice(F.array_sort(F.collect_list(F.struct("block_no", "text"))), 1, blocks_most)
    joined = F.array_join(F.transform(listed, lambda x: x["text"]), " ")
    return blocks.where(wanted).groupBy(page).agg(F.substring(F.trim(F.regexp_replace(joined, r"\s+", " ")), 1, most).alias("text"))
