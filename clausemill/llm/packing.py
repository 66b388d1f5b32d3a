"""Best-fit packing: best-two-fit over the lengths of all pieces.

Only lengths matter to a packing, and there are no more of them than a sequence has tokens. So the
pieces are counted by length, the table of counts (2,048 rows at any size of the corpus) is packed on
the driver, each pattern of lengths with the number of sequences that it fills, and the pieces take
their places by rank within their length. A sequence is filled greedily, longest first; then its
smallest piece makes way for two unpacked ones that fill its gap more tightly, as long as there are such.
Pieces of the same length are told apart by buckets of their ids, so a length that very many share is
ranked by many tasks.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed as any other; repeated
rows are pieces of their own; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import stage, table
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of more than `capacity` ids are cut."""
    end = array("I", [end_id]).tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).ids
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with its number of sequences, that use up `counts` (by length)."""
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[list[int], int]] = []
    lengths = np.arange(capacity + 1)

    def fitting(free: np.ndarray) -> np.ndarray:
        """The largest free length up to each length, 0 for none."""
        return np.maximum.accumulate(np.where(free > 0, lengths, 0))

    while left.any():
        free = left.copy()
        bin_: list[int] = []
        gap = capacity
        while gap and (take := int(fitting(free)[gap])):
            bin_.append(take)
            free[take] -= 1
            gap -= take
        while gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            first = lengths[1 : room + 1]
            first = first[free[1 : room + 1] > 0]
            second = fitting(free)[room - first]
            # two of one length need two of it; else the next smaller partner
            twice = (second == first) & (free[first] < 2)
            if twice.any():
                k = int(first[twice][0])
                less = fitting(np.where(lengths == k, 0, free))
                second = np.where(twice, less[room - first], second)
            both = np.where(second > 0, first + second, 0)
            if not len(both) or both.max() <= small:
                break
            k = int(both.argmax())
            bin_.remove(small)
            free[small] += 1
            for x in (int(first[k]), int(second[k])):
                bin_.append(x)
                free[x] -= 1
            gap = capacity - sum(bin_)
        used, n = np.unique(bin_, return_counts=True)
        times = int((left[used] // n).min())
        left[used] -= n * times
        patterns.append((sorted(bin_, reverse=True), times))
    return patterns


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of ranks, its first sequence, and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    cursor: dict[int, int] = {}
    sequence = 0
    for bin_, times in patterns:
        offset = 0
        for x in bin_:
            at = cursor.get(x, 0)
            runs.setdefault(x, []).append((at, sequence, offset))
            cursor[x] = at + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(items: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """`items` (narrow, staged, with `length` from 1 to `capacity`) with sequence_id and offset.

    `key` orders pieces of one length; rows that are equal in it may swap their places.
    """
    spark = items.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = items.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    counted = stage(placed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    places = _places(best_two_fit(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.empty((2, len(lengths)), dtype=np.int64)
        for x in np.unique(lengths):
            here = np.flatnonzero(lengths == x)
            first, sequence, offset = places[int(x)]
            k = np.searchsorted(first, ranks[here], side="right") - 1
            out[0, here] = sequence[k] + ranks[here] - first[k]
            out[1, here] = offset[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    so_far = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "_bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("_before"))
    in_bucket = Window.partitionBy("length", "_bucket").orderBy(*key)
    # the rows lie by length and bucket already: a merge moves the starts to them, and nothing is broadcast
    ranked = placed.withColumn("_in", F.row_number().over(in_bucket) - 1).join(starts.hint("merge"), ["length", "_bucket"])
    ranked = ranked.withColumn("_place", place("length", F.col("_in") + F.col("_before")))
    return ranked.select(*items.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    cut = stage(pieces(docs, tokenizer or default_path(), capacity), "pack-pieces")
    return pack(cut, ["doc_id", "piece"], capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, the last stage: the pieces of all documents and their places."""
    return pack_documents(docs)


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}  # a tokenizer and a packing: tests hold it against brute force
