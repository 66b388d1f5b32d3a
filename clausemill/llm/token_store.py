"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks at places that depend on nearby
ids only, so copies and near copies share chunks. A chunk is named by the digest of its ids and stored
once. A document is a recipe: its chunks' digests in order. A Merkle manifest over the recipes, in
ascending doc_id order, ends in one digest that vouches for all of them.

Files (Parquet, under one folder):
* `encoded`: rows of kind chunk: key, payload. A payload is a byte that gives the width of an id, 2 or 4, and the
  zstd frame of the ids, little-endian. (Those of kind recipe are where recipes come from, unordered.)
* `recipes/part=P`: rows in ascending doc_id order, from part to part and within one: `at`, the row's number
  in its part, `before`, the ids of the part's rows before it, doc_id, n_tokens, digests, counts, key.
* `manifest`: level, node, digest. A leaf, a recipe's key, is the digest over its doc_id, place, counts and chunk
  digests; a node is the digest of LEAF numbered nodes below; the last level has one node.

Reading verifies: a payload must hash to its name, a chunk must be there and have the number of ids its
recipes say, a recipe's counts must add up, and the leaves, made anew from what the recipe files hold, must
give the manifest's root; otherwise the query fails. The checksum of a
document's ids is put together from those of its chunks (a CRC of a concatenation is a linear function of
the CRCs of its parts), so payloads are read once, where they lie, and not moved.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; repeated rows are
documents of their own; an empty table gives an empty result and an empty manifest; only the columns
named are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import shared_dir, stage, table
from .tokens import default_path, encoder

END_ID = 1
WINDOW = 16  # ids that a cut depends on
MEAN, LEAST, MOST = 512, 128, 4096  # ids in a chunk; MEAN is a power of two
REMEMBERED = 200_000  # digests that a task knows it has emitted
LEAF = 1024  # nodes under a node of the manifest

_ENCODED = pa.schema(
    [
        ("kind", pa.string()),
        ("key", pa.binary()),
        ("payload", pa.binary()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("digests", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int32())),
    ]
)
_ENCODED_SQL = (
    "kind string, key binary, payload binary, doc_id long, n_tokens long, "
    "digests array<binary>, counts array<int>"
)


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of a non-empty id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = ids * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA6B)
    total = np.cumsum(mixed, dtype=np.uint32)
    rolling = total.copy()
    rolling[WINDOW:] -= total[:-WINDOW]
    rolling *= np.uint32(0xC2B2AE35)
    wanted = np.flatnonzero((rolling >> np.uint32(16)) & np.uint32(MEAN - 1) == 0) + 1
    ends, last = [], 0
    for end in wanted.tolist():
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST and n - end >= 1:
            ends.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def leaf(doc_id: int | None, before: int, counts: list[int], digests: list[bytes]) -> bytes:
    """The digest that stands for a document in the manifest."""
    return digest(f"{doc_id} {before} {counts} ".encode() + b"".join(digests))


def from_payload(payload: bytes, unpress: zstandard.ZstdDecompressor) -> bytes:
    raw = np.frombuffer(unpress.decompress(payload[1:]), dtype="<u2" if payload[0] == 2 else "<u4")
    return raw.astype("<u4").tobytes()


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Chunk rows, once in each task as far as it remembers, and a recipe row for each document."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, press, seen = encoder(tokenizer).ids, zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            columns, size = [[] for _ in _ENCODED], 0
            kind, key, payload, doc, n_tokens, digests, all_counts = (c.append for c in columns)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids_of(text.as_py() or "") + end
                ids = np.frombuffer(data, dtype="<u4")
                width = 2 if int(ids.max()) < 65536 else 4
                narrow = ids.astype("<u2").tobytes() if width == 2 else data
                names, counts, last = [], [], 0
                for e in cuts(ids):
                    name = digest(data[4 * last : 4 * e])
                    if name not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(name)
                        pressed = bytes([width]) + press.compress(narrow[width * last : width * e])
                        size += len(pressed)
                        kind("chunk"), key(name), payload(pressed)
                        doc(None), n_tokens(None), digests(None), all_counts(None)
                    names.append(name)
                    counts.append(e - last)
                    last = e
                kind("recipe"), key(digest(b"".join(names))), payload(None)
                doc(doc_id), n_tokens(len(ids)), digests(names), all_counts(counts)
                if size > 4_000_000 or len(columns[0]) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENCODED)], schema=_ENCODED)
                    for c in columns:
                        c.clear()
                    size = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENCODED)], schema=_ENCODED)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED_SQL)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition, where equal chunks lie together: all recipes, and the first of equal chunks.

    It keeps the names that it has met: no more than a partition has, and no order is needed.
    """
    met: set[bytes] = set()
    for batch in batches:
        keys, chunk = batch.column(1).to_pylist(), pc.equal(batch.column(0), "chunk").to_pylist()
        keep = [not c or (k not in met and not met.add(k)) for k, c in zip(keys, chunk)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the store: one pass over the texts, one shuffle of chunks, one of recipes by range."""
    spark = docs.sparkSession
    # recipes of documents that are alike have one key: their ids deal them out
    rows = encoded(docs, tokenizer or default_path(), end_id).repartition(F.xxhash64("key", F.coalesce("doc_id", F.lit(-1))))
    rows.mapInArrow(_once, _ENCODED_SQL).write.option("compression", "none").parquet(f"{path}/encoded")  # payloads are pressed
    found = spark.read.schema(_ENCODED_SQL).parquet(f"{path}/encoded").where("kind = 'recipe'").drop("kind", "payload")
    placed = found.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "doc_id", "key")
    placed.mapInArrow(_placed, _RECIPE_SQL + ", part int").write.partitionBy("part").parquet(f"{path}/recipes")
    manifest(_at_row(_recipes(spark, path), "key")).write.parquet(f"{path}/manifest")


_RECIPE_SQL = "at long, before long, doc_id long, n_tokens long, digests array<binary>, counts array<int>, key binary"


def _leaves(doc_ids: pa.Array, before: pa.Array, counts: pa.Array, digests: pa.Array) -> pa.Array:
    return pa.array(map(leaf, doc_ids.to_pylist(), before.to_pylist(), counts.to_pylist(), digests.to_pylist()), pa.binary())


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the recipes of a part, in order: with their numbers, the ids before them, and their leaves as keys."""
    rows = ids = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, doc_ids, n_tokens, digests, counts, part = batch.columns
        ends = np.cumsum(n_tokens.to_numpy(), dtype=np.int64) + ids
        before = pa.array(np.concatenate([[ids], ends[:-1]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows, rows + len(ends))), before, doc_ids, n_tokens, digests, counts, _leaves(doc_ids, before, counts, digests), part],
            names=["at", "before", "doc_id", "n_tokens", "digests", "counts", "key", "part"],
        )
        rows, ids = rows + len(ends), int(ends[-1])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE_SQL + ", part int").parquet(f"{path}/recipes")


def _at_row(rows: DataFrame, node: str) -> DataFrame:
    """`rows` (part, at, before, n_tokens) with `row_no` and `start` over all parts, and `leaf` of column `node`."""
    totals = rows.groupBy("part").agg(F.max(F.struct("at", (F.col("before") + F.col("n_tokens")).alias("ids"))).alias("last"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    firsts = totals.select(
        "part",
        F.coalesce(F.sum(F.col("last.at") + 1).over(so_far), F.lit(0)).alias("_row"),
        F.coalesce(F.sum("last.ids").over(so_far), F.lit(0)).alias("_ids"),
    )
    return (
        rows.join(F.broadcast(firsts), "part")
        .withColumns({"row_no": F.col("_row") + F.col("at"), "start": F.col("_ids") + F.col("before"), "leaf": F.col(node)})
        .drop("_row", "_ids")
    )


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """From the files, with `row_no`, `start` (the ids of all documents before), `leaf` and `after` (the ids after each chunk).

    Leaves are made anew from what the files hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, before, doc_ids, n_tokens, digests, counts, _, part = batch.columns
            after = []
            for n, c in zip(n_tokens.to_pylist(), counts.to_pylist()):
                left = np.cumsum(c[::-1], dtype=np.int64)[::-1]
                if n != left[0]:
                    raise ValueError("a recipe's counts don't add up")
                after.append([*left[1:].tolist(), 0])
            yield pa.RecordBatch.from_arrays(
                [at, before, doc_ids, n_tokens, digests, counts, part, pa.array(after, pa.list_(pa.int64())), _leaves(doc_ids, before, counts, digests)],
                names=["at", "before", "doc_id", "n_tokens", "digests", "counts", "part", "after", "made"],
            )

    ship(spark)
    schema = "at long, before long, doc_id long, n_tokens long, digests array<binary>, counts array<int>, part int, after array<long>, made binary"
    return _at_row(_recipes(spark, path).mapInArrow(run, schema), "made")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema("kind string, key binary, payload binary").parquet(f"{path}/encoded").where(F.col("kind") == kind)


def manifest(ordered: DataFrame) -> DataFrame:
    """(level, node, digest) over `ordered` (row_no, leaf): level 0 has a node for LEAF recipes, the last level has one node."""
    nodes = ordered.select(F.col("row_no").alias("node"), F.hex("leaf").alias("digest"))
    levels, level = [], 0
    while True:
        grouped = nodes.groupBy(F.floor(F.col("node") / LEAF).cast("long").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("below")  # LEAF at most
        )
        # the numbers of the nodes below are part of a digest: a gap or a row twice gives another
        below = F.array_join(F.transform("below", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), " ")
        nodes = stage(grouped.select(F.col("up").alias("node"), F.sha2(below, 256).alias("digest")), f"store-manifest-{level}")
        levels.append(nodes.select(F.lit(level).alias("level"), "node", "digest"))
        if nodes.limit(2).count() < 2:
            break
        level += 1
    return reduce(DataFrame.unionByName, levels)


def root(of: DataFrame) -> str | None:
    top = of.orderBy(F.desc("level")).limit(1).collect()
    return top[0]["digest"] if top else None


def verified(spark: SparkSession, path: str) -> DataFrame:
    """`recipes` of the store, staged, once they have given the stored manifest's root."""
    ordered = stage(recipes(spark, path), "store-recipes")
    if root(manifest(ordered)) != root(spark.read.schema("level int, node long, digest string").parquet(f"{path}/manifest")):
        raise ValueError("the recipes don't give the manifest's root")
    return ordered


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, crc) of every stored chunk, read back and held against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc = [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = from_payload(payload.as_py(), unpress)
                if digest(data) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't hash to its name")
                n.append(len(data) // 4)
                crc.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "n", "crc"])

    ship(spark)
    return _read(spark, path, "chunk").select("key", "payload").mapInArrow(run, "key binary, n long, crc long")


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray | np.uint32, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC's, bits reflected."""
    out = np.zeros_like(b)
    b = b.copy()
    for k in range(32):
        out ^= np.where((a >> np.uint32(31 - k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def crc_before(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What `crc` of a part adds to the checksum of a whole that has `n_bytes` more after the part."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.int64)
    power = np.array([0x00800000], dtype=np.uint32)  # x^8: one byte
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = _times(power[0], out[odd])
        power = _times(power[0], power)
        left = left >> 1
    return out


@F.pandas_udf(T.LongType())
def _crc_term(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(crc_before(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))


def read_back(ordered: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, a row for each recipe."""
    kept = ["row_no", "doc_id", "start"]
    parts = ordered.select(*kept, F.explode(F.arrays_zip("digests", "counts", "after")).alias("p"))
    parts = parts.select(*kept, F.col("p.digests").alias("key"), F.col("p.counts").alias("count"), F.col("p.after").alias("after"))
    found = parts.join(chunks, "key", "left")
    whole = F.when(F.col("n") == F.col("count"), F.col("n")).otherwise(
        F.raise_error(F.lit("a recipe names a chunk that isn't stored as it says")).cast("long")
    )
    return (
        found.select(*kept, whole.alias("n"), _crc_term("crc", "after").alias("term"))
        .groupBy("row_no")
        .agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("term").alias("ids_crc32"))
        .drop("row_no")
    )


def reconstruct(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the documents of `wanted` (doc_id), whole, from the files."""

    @F.pandas_udf("array<int>")
    def ids(payload: pd.Series) -> pd.Series:
        unpress = zstandard.ZstdDecompressor()
        return payload.map(lambda p: np.frombuffer(from_payload(p, unpress), dtype="<u4").astype(np.int32))

    found = verified(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = found.select("row_no", "doc_id", F.posexplode("digests").alias("k", "key"))
    chunks = _read(spark, path, "chunk").select("key", "payload")
    return (
        parts.join(chunks, "key")
        .select("row_no", "doc_id", "k", ids("payload").alias("ids"))
        .groupBy("row_no", "doc_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
        .drop("row_no")
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read_back(verified(spark, path), chunk_sums(spark, path))


QUERIES = {"op9_token_store": op9_token_store}
ORACLE_SQL: dict[str, str] = {}  # a tokenizer and files: tests hold it against brute force
