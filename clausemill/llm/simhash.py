"""SimHash near-dedup with pivot distance tables.

Fingerprints come from word shingles; distinct ones only go on, so exact copies cost nothing further.
A fingerprint is cut into blocks of bits: if two differ in at most three bits, they agree on all blocks but three
at least. So a table for each choice of the blocks to agree on deals fingerprints into small groups, and none
loses a link. The more fingerprints there are, the more blocks: four to agree on one (16 bits), five on
two (26 bits), six on three (32 bits), so that a group of random fingerprints stays under GROUP, and links
sought grow with the fingerprints, not with their square. Within a group, a table of Hamming distances to fixed reference fingerprints
(pivots) is computed; by the triangle inequality a pair whose distances to any pivot differ by more
than three can't link. The group is swept in order of the first pivot's distance, the other
coordinates discard by their maximum difference, and an exact comparison verifies the survivors. A
group's links leave it as a spanning forest, never as all pairs; a group beyond BLOCK members is dealt
into parts whose pairs are tasks of their own, so no task holds an unbounded group.

Defined cases: a null or empty text has fingerprint zero and links like any other; a null doc_id gets
a fingerprint and the component of its group, whose id is the smallest doc_id that isn't null; repeated
rows come back each; an empty table gives an empty result; only the columns named are read. The pipeline's
stage keeps a row of each component, whether or not its doc_id is null or repeated: a row is told by its
doc_id and its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import components, stage, table

SHINGLE = 3
RADIUS = 3
N_PIVOTS = 12
GROUP = 512  # random fingerprints that share a group at most, on average
BLOCK = 2048

_hash = xxhash.xxh64_intdigest
#: Reference fingerprints: 64-bit hashes of 0, 1, 2 ...
PIVOTS = np.array([_hash(str(i).encode(), 7) for i in range(N_PIVOTS)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [_hash(b" ".join(words), 42)]
    else:
        hashes = [_hash(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for a text of any length
        part = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """(doc_id, fp), and `key` if given: fp a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key"][: len(columns)])

    ship(docs.sparkSession)
    more = [] if key is None else [key.alias("key")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(
        run, "doc_id long, fp long" + ", key string" * len(more)
    )


def layout(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """For n fingerprints: blocks of bits (first, width), and the blocks that each table agrees on."""
    for k in range(radius + 1, 2 * radius + 3):
        edges = [64 * i // k for i in range(k + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        tables = list(combinations(range(k), k - radius))
        if n >> min(sum(blocks[i][1] for i in t) for t in tables) <= GROUP:
            break
    return blocks, tables


def _group(fp: Column, number: int, blocks: list[tuple[int, int]]) -> Column:
    """A fingerprint's group in a table: the bits to agree on, and the table's number above them."""
    width = sum(w for _, w in blocks)
    parts, at = [F.lit(number << width).cast("long")], 0
    for first, w in blocks:
        parts.append(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << w) - 1).cast("long")), at))
        at += w
    return reduce(Column.bitwiseOR, parts)


def _forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key, as (member, smallest member of its group of linked rows)."""
    table_ = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table_[:, 0], keys))
    keys, fps, table_ = keys[order], fps[order], table_[order]
    n = len(fps)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = np.arange(n)
    for step in range(1, n):
        left = left[left + step < n]
        right = left + step
        near = (keys[left] == keys[right]) & (table_[right, 0] - table_[left, 0] <= radius)
        left = left[near]  # sorted by the first coordinate: a later partner is no nearer
        if not len(left):
            break
        a, b = left, left + step
        for k in range(1, N_PIVOTS):
            close = np.abs(table_[a, k] - table_[b, k]) <= radius
            a, b = a[close], b[close]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        for i, j in zip(a[linked].tolist(), b[linked].tolist()):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(n)], dtype=np.int64)
    member = np.flatnonzero(roots != np.arange(n))
    return fps[member], fps[roots[member]]


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """From rows (key long, fp long), sorted by key within partitions: a forest of links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, fps = (np.concatenate(x) for x in zip(*parts))
            a, b = _forest(keys, fps.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                yield flush([*held, (keys[:cut], fps[:cut])])
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield flush(held)

    ship(rows.sparkSession)
    return rows.select("key", "fp").mapInArrow(run, "a long, b long")


def link_distinct(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, n: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of `distinct` (fp long, no repeats) as those within `radius` do; n: lays out tables for so many."""
    blocks, tables = layout(distinct.count() if n is None else n, radius)
    groups = [_group(F.col("fp"), k, [blocks[i] for i in t]) for k, t in enumerate(tables)]
    banded = distinct.select("fp", F.explode(F.array(*groups)).alias("band"))
    large = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = large.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = banded.join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # every pair of blocks is a group: a member goes to those that its own block is part of
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.when(F.col("blocks") == 1, F.col("band")).otherwise(
            F.xxhash64("band", F.least(mine, other), F.greatest(mine, other))
        ),
    )
    rows = dealt.select("fp", F.explode(pairs).alias("key"))
    return _links(rows.repartition("key").sortWithinPartitions("key"), radius)


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints: `first` aggregated over each, root that of its component."""
    distinct = stage(prints.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    linked = components(link_distinct(distinct.select("fp")))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    return stage(rooted, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`."""
    prints = stage(fingerprints(docs, id_col, text), "simhash-fingerprints")
    rooted = _rooted(prints, F.min("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of linked documents one with the smallest doc_id stays, null being the largest."""
    # a row's doc_id and text in one column that is never null: join and dropDuplicates share one shuffle of texts
    key = F.concat_ws(" ", F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("t"), F.coalesce(F.sha2("text", 256), F.lit(""))))
    prints = stage(fingerprints(docs, key=key), "simhash-fingerprints")
    rooted = _rooted(prints, F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("s")).select(F.col("s.key").alias("_key"))
    return docs.withColumn("_key", key).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}  # XXH64 is no DuckDB function; tests hold it against brute force
