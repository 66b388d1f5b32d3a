"""Segments of a text: offsets, running headers, trailing matter, interval lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_digits

SEPARATOR = "\n\n"


def with_offsets(segments: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """char_start and char_end in the text that joins a document's segments with SEPARATOR."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + len(SEPARATOR)).over(before), F.lit(0)).cast("int")
    return segments.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def reassembled(segments: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return segments.groupBy(doc).agg(F.array_join(parts, SEPARATOR).alias("text"))


def running_lines(lines: DataFrame, book: str, page: str, line: str = "line", least_pages: int = 4) -> DataFrame:
    """(book, norm, n_pages): lines of ten characters or more, digits aside, that run through a book."""
    pages = lines.groupBy(book).agg(F.count_distinct(page).alias("pages"))
    normal = lines.withColumn("norm", without_digits(F.col(line))).where(F.length("norm") >= 10)
    seen = normal.groupBy(book, "norm").agg(F.count_distinct(page).alias("n_pages"))
    threshold = F.greatest(F.lit(3), F.floor(0.4 * F.col("pages")).cast("int"))
    return seen.join(pages, book).where((F.col("pages") >= least_pages) & (F.col("n_pages") >= threshold)).drop("pages")


def without_running_lines(lines: DataFrame, book: str, page: str, line: str = "line") -> DataFrame:
    running = running_lines(lines, book, page, line).select(book, "norm")
    return lines.withColumn("norm", without_digits(F.col(line))).join(running, [book, "norm"], "left_anti").drop("norm")


def band(lines: DataFrame, page: list[str], order: str) -> DataFrame:
    """Adds in_band: among the first or last two lines of a page of more than four (blank lines aside, which `lines` has none of)."""
    w = Window.partitionBy(*page)
    up, down = w.orderBy(order), w.orderBy(F.col(order).desc())
    edge = (F.row_number().over(up) <= 2) | (F.row_number().over(down) <= 2)
    return lines.withColumn("in_band", edge & (F.count(F.lit(1)).over(w) > 4))


def cells_header(line: Column) -> Column:
    """A navigation header: two cells set apart by two spaces or more, neither a sentence."""
    cells = F.split(F.trim(line), r"\s{2,}")
    return (F.size(cells) == 2) & (F.length(line) <= 120) & ~F.trim(line).rlike(r"[.;:]$")


def located(points: DataFrame, segments: DataFrame, doc: str, point: str = "char_start") -> DataFrame:
    """Each point's segment number, by half-open intervals; the last segment holds its end; null in a separator.

    Both sides are sorted by offset within a document and the last segment begun is carried forward,
    so no pairs of points and segments are made.
    """
    last = Window.partitionBy(doc)
    s = segments.select(
        F.col(doc), F.col("char_start").alias("_at"), F.lit(0).alias("_kind"),
        F.struct("seg_no", "char_start", "char_end", (F.max("char_start").over(last) == F.col("char_start")).alias("last")).alias("_seg"),
        F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in points.schema) + ">").alias("_point"),
    )
    p = points.select(F.col(doc), F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(s.schema["_seg"].dataType).alias("_seg"), F.struct(*points.columns).alias("_point"))
    w = Window.partitionBy(doc).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = s.unionByName(p).withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).where("_kind = 1")
    inside = (F.col("_at") < F.col("_seg.char_end")) | (F.col("_seg.last") & (F.col("_at") == F.col("_seg.char_end")))
    return held.select(*[F.col(f"_point.`{c}`").alias(c) for c in points.columns], F.when(inside, F.col("_seg.seg_no")).alias("seg_no"))
