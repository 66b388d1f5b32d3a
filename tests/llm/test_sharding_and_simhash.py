import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausemill.llm import sharding, simhash
from clausemill.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation_is_one(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_permutation_mixes(spark):
    got = [r.p for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000).alias("p")).orderBy("id").collect()]
    assert abs(np.corrcoef(range(1000), got)[0, 1]) < 0.15
    other = [r.p for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000, seed=1).alias("p")).orderBy("id").collect()]
    assert other != got


def feistel(x, n, seed=sharding.SEED):
    """The permutation by plain arithmetic, with XXH64 as Spark chains it over the columns."""
    a = int((n - 1) ** 0.5)
    while a * a <= n - 1:
        a += 1
    b = -(-n // a)

    def mix(half, k, size):
        h = 42
        for part in (half.to_bytes(8, "little"), k.to_bytes(4, "little"), seed.to_bytes(4, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        return (h - (1 << 64) if h >> 63 else h) % size

    while True:
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            if k % 2 == 0:
                left = (left + mix(right, k, a)) % a
            else:
                right = (right + mix(left, k, b)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [2, 7, 100, 1001])
def test_permutation_matches_plain_arithmetic(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()]
    assert got == [feistel(x, n) for x in range(n)]


def test_shards_match_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op7_feistel_sharding(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    order = sorted(got, key=lambda r: (r.doc_id, r.text_crc32, r.size))
    assert [(r.shard, r.slot) for r in order] == [(p % 8, p // 8) for p in (feistel(x, len(order)) for x in range(len(order)))]
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.op7_feistel_sharding(spark, SF).collect()))


def test_shard_handles_ties_and_empty(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 2), (1, 2)], "doc_id long, size long")
    got = sharding.shard(rows, ["doc_id", "size"], 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sharding.shard(rows.limit(0), ["doc_id"], 3).count() == 0


def fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(sh))


def classes(prints, ids):
    """Component ids by comparing every pair."""
    n = len(prints)
    seen, comp = [-1] * n, [None] * n
    for i in range(n):
        if seen[i] >= 0:
            continue
        todo, group = [i], []
        seen[i] = i
        while todo:
            a = todo.pop()
            group.append(a)
            for b in range(n):
                if seen[b] < 0 and bin(prints[a] ^ prints[b]).count("1") <= 3:
                    seen[b] = i
                    todo.append(b)
        known = [ids[g] for g in group if ids[g] is not None]
        for g in group:
            comp[g] = min(known) if known else None
    return comp


def check(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _, _), p, c in zip(rows, prints, classes(prints, [r[0] for r in rows]))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_fingerprints_and_classes_match_brute_force(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(120):
        if d % 3 and rows:
            w = rows[random.randrange(len(rows))][1].split()
            for _ in range(random.randrange(3)):
                w[random.randrange(len(w))] = random.choice(words)
        else:
            w = random.choices(words, k=150)
        rows.append((d, " ".join(w), "en"))
    check(spark, rows)


def test_edges(spark):
    check(spark, [(5, None, "x"), (4, "", None), (3, "\x0b \n", "x"), (9, "One", "x"), (9, "ONE", "x"), (2, "one two", "x"), (None, "One", "x"), (7, "É é", "x"), (8, "a\x1cb c", "x"), (1, "word " * 70_000, "x")])


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c", "x")], SCHEMA).withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    assert simhash.near_duplicates(df).count() == 1


def test_layout_grows_with_the_fingerprints():
    for n, k in ((0, 4), (10**7, 4), (10**9, 5), (10**10, 5), (10**12, 6)):
        blocks, tables = simhash.layout(n)
        assert len(blocks) == k and sum(w for _, w in blocks) == 64 and n >> min(sum(blocks[i][1] for i in t) for t in tables) <= simhash.GROUP
    assert [len(simhash.layout(n)[1]) for n in (1, 10**9, 10**12)] == [4, 10, 20]


@pytest.mark.parametrize("n", [1, 10**9, 10**12])
def test_blocks_of_a_large_group_lose_no_link(spark, n):
    random.seed(2)
    base = random.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in random.sample(range(64), random.randrange(6))) for _ in range(300)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.link_distinct(spark.createDataFrame(signed, "fp long"), block=16, n=n)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
    want = classes(prints, list(range(len(prints))))
    by_want, by_got = {}, {}
    for p, c in zip(prints, want):
        by_want.setdefault(c, set()).add(p)
        by_got.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[901] == 900


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "x"), (3, "other words here now", "x")], SCHEMA)
    kept = simhash.stage_near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_stage_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "alone without any id", "x"), (None, "a b c d", "x"), (None, "twins of null id here", "x"), (None, "twins of null id here", "x"), (1, "a b c d", "x"), (7, "first of seven is this", "x"), (7, "second one quite unlike it", "x"), (8, "second one quite unlike it", "x"), (9, None, "x")]
    kept = simhash.stage_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    want = [(None, "alone without any id"), (None, "twins of null id here"), (1, "a b c d"), (7, "first of seven is this"), (7, "second one quite unlike it"), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)
