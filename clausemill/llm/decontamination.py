"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set. Its word pairs are counted over all documents: one pass. In a copy of an
item of m words up to a fifth of them are lost, and up to a quarter of those kept may be added between: a
lost word spoils two pairs, an added one one, so of the m - 1 pairs at least L, about 0.4 m - 1, are left.
So any m - L of them hold one that is left (all but those would be L - 1): the rarest m - L pairs
of an item are its seeds, and a second pass joins documents to items by these alone. Pairs of common words
are seeds only where an item has nothing rarer, and an item whose rarest m - L pairs occur nowhere is not
looked for at all. Pairs, not runs of three: words lost and words added, spread evenly, can leave no
three in a row.
A seed anchors the alignment: the window around it, as far as a copy can reach, is aligned to the item, word
by word; the rarest come first, and seeds that an aligned copy covers anchor no more. A window
counts if matches make up SIMILARITY of the longer of the item and its aligned stretch, or of any
part of that, or, where that falls short, of any stretch of the window. However many documents hold a
passage, it counts: rarity only chooses the seeds. Items of a few words can occur by chance; a caller
who wants to leave these out has `rarest_docs`.

Seeds are kept by each task, in blocks of at most MAX_SEEDS: a benchmark beyond that takes two
passes over the documents for each block. Windows that are alike are aligned once, so a passage in very
many documents costs little. No document is moved: the only shuffle is of counts by seed.

Defined cases: a null or empty text, of a document or an item, matches nothing; an item of one or two
words is its own seed; null ids are carried through; repeated rows come back each; an empty table on
either side gives an empty result; a very long text is read once, with memory for its words and the places
of its seeds; only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import stage, table

N = 2
SIMILARITY = 0.8
MATCH = 4
MAX_SEEDS = 400_000  # about 100 MB in a task
REMEMBERED = 5_000  # alignments that a task remembers

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str], n: int = N) -> list[tuple[str, ...]]:
    """Runs of n words; of fewer words, the whole."""
    if not words:
        return []
    return list(zip(*(words[i:] for i in range(min(n, len(words))))))


def least_seeds(m: int, n: int = N, similarity: float = SIMILARITY) -> int:
    """Seeds that a copy of m words, similar enough, keeps at least.

    A word lost (left out or replaced) spoils n of them, one added between two others n - 1.
    """
    worst = 0
    for lost in range(m + 1):
        kept = m - lost
        if kept + 1e-9 < similarity * m:
            break
        worst = max(worst, n * lost + (n - 1) * (int(kept / similarity + 1e-9) - kept))
    return max(1, max(m - n + 1, 1) - worst)


def _best_part(places: list[int], m: int) -> tuple[float, int, int]:
    """Of an alignment that matches words at `places` of a window: its most similar part, the first of equals."""
    at = np.array(places)
    best = (0.0, 0, 0)
    for a in range(len(at)):
        if best[0] >= (len(at) - a) / m:  # no part from here on can be better
            break
        ratios = np.arange(1, len(at) - a + 1) / np.maximum(m, at[a:] - at[a] + 1)
        b = int(ratios.argmax())
        if ratios[b] > best[0]:
            best = (float(ratios[b]), int(at[a]), int(at[a + b]) + 1)
    return best


def _best_stretch(item: tuple[str, ...], window: tuple[str, ...]) -> tuple[float, int, int]:
    """Of all stretches of a window the most similar, by their longest common subsequence with the item (in bits)."""
    m = len(item)
    bits: dict[str, int] = {}
    for p, w in enumerate(item):
        bits[w] = bits.get(w, 0) | 1 << p
    all_ones = (1 << m) - 1
    best = (0.0, 0, 0)
    for start, first in enumerate(window):
        if first not in bits:
            continue
        row = all_ones  # a zero for each word of the subsequence
        for end in range(start, min(len(window), start + int(m / SIMILARITY + 1e-9) + 1)):
            hit = bits.get(window[end])
            if hit is None:
                continue
            u = row & hit
            row = ((row + u) | (row - u)) & all_ones
            ratio = (m - row.bit_count()) / max(m, end + 1 - start)
            if ratio > best[0]:
                best = (ratio, start, end + 1)
    return best


def align(item: tuple[str, ...], window: tuple[str, ...]) -> tuple[float, int, int]:
    """Smith-Waterman: similarity, and the aligned stretch of the window as [start, end).

    Match MATCH, mismatch and gap -1, so that a few words beyond a run of edits still belong to a copy; of
    the best local alignment, matches over the longer of the item and the aligned stretch, at that part
    where it is highest. An alignment that goes on to words beyond a copy, or takes another way, can fall
    short of SIMILARITY where a stretch doesn't: then all stretches are compared.
    """
    m = len(item)
    first = item[0]
    for at, w in enumerate(window):  # a verbatim copy needs no table
        if w == first and window[at : at + m] == item:
            return 1.0, at, at + m
    if not set(item).intersection(window):
        return 0.0, 0, 0
    # a cell: score, matches, and the places matched as (last, those before); better score, then more matches
    zero: tuple = (0, 0, None)
    row = [zero] * (len(window) + 1)
    best = zero
    for a in item:
        diagonal, left, new = row[0], zero, [zero]
        for j, b in enumerate(window, 1):
            up = row[j]
            if a == b:
                cell = (diagonal[0] + MATCH, diagonal[1] + 1, (j - 1, diagonal[2]))
            else:
                cell = (diagonal[0] - 1, diagonal[1], diagonal[2])
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = zero
            elif cell[:2] > best[:2]:
                best = cell
            new.append(cell)
            diagonal, left = up, cell
        row = new
    places, chain = [], best[2]
    while chain:
        places.append(chain[0])
        chain = chain[1]
    found = _best_part(places[::-1], m)
    return found if found[0] >= SIMILARITY else max(found, _best_stretch(item, window), key=lambda x: x[0])


def _may_match(item: tuple[str, ...], window: tuple[str, ...], similarity: float) -> bool:
    """Whether the window has enough of the item's words, in any order."""
    return (Counter(item) & Counter(window)).total() >= similarity * len(item) - 1e-9


class _Memory(OrderedDict):
    def align(self, item_no: int, item: tuple[str, ...], window: tuple[str, ...], similarity: float) -> tuple[float, int, int]:
        key = (item_no, window)
        if key not in self:
            if len(self) >= REMEMBERED:
                self.popitem(last=False)
            self[key] = align(item, window) if _may_match(item, window, similarity) else (0.0, 0, 0)
        return self[key]


Item = tuple[int, tuple[str, ...]]  # id, words


def _tasks(docs: DataFrame, run, schema) -> DataFrame:
    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _found(words: list[str], index: dict[tuple[str, ...], int], sizes: list[int]) -> list[tuple[int, int]]:
    """(place, number) of the grams of `words` that `index` has."""
    return [(at, k) for n in sizes for at, k in enumerate(map(index.get, zip(*(words[i:] for i in range(n))))) if k is not None]


def document_counts(docs: DataFrame, grams: list[tuple[str, ...]]) -> dict[int, int]:
    """By number of each gram that occurs: the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast({g: k for k, g in enumerate(grams)})  # MAX_SEEDS at most
    sizes = sorted({len(g) for g in grams})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n_docs = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                n_docs.update({k for _, k in _found(words_of(text.as_py()), index, sizes)})
        yield pa.RecordBatch.from_arrays([pa.array(list(n_docs), pa.int32()), pa.array(list(n_docs.values()), pa.int64())], names=["gram", "n"])

    counted = _tasks(docs.select("text"), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}  # MAX_SEEDS rows at most


def rare_seeds(items: list[Item], n_docs: dict[tuple[str, ...], int], similarity: float = SIMILARITY) -> dict[tuple[str, ...], list[int]]:
    """By seed, the numbers of its items: of each item the rarest pairs that a copy can't all have lost."""
    out: dict[tuple[str, ...], dict[int, None]] = {}
    for k, (_, words) in enumerate(items):
        grams = _grams(list(words))
        enough = len(grams) - least_seeds(len(words), similarity=similarity) + 1
        for _, p in sorted((n_docs.get(g, 0), p) for p, g in enumerate(grams))[:enough]:
            if grams[p] in n_docs:  # what no document holds finds nothing
                out.setdefault(grams[p], {})[k] = None
    return {g: list(ks) for g, ks in out.items()}


def _best(words: list[str], item_no: int, item: tuple[str, ...], hits: list[tuple[int, int]], similarity: float, memory: _Memory) -> tuple[float, int, int]:
    """The best copy around `hits` (documents that hold the seed, place), those of the rarest seeds first."""
    reach = int(len(item) / similarity + 1e-9) + N
    done: list[tuple[int, int]] = []
    best = (0.0, 0, 0)
    for _, place in sorted(hits):
        if any(lo <= place and place + N <= hi for lo, hi in done):
            continue
        lo = max(0, place - reach)
        score, start, end = memory.align(item_no, item, tuple(words[lo : place + reach + N]), similarity)
        if score >= similarity:
            done.append((lo + start, lo + end))
        if score > best[0]:
            best = (score, lo + start, lo + end)
        if score == 1.0:
            break
    return best


class Finder:
    """The copies of a block of items in a text, by the rare seeds. It is small, and each task has one."""

    def __init__(self, items: list[Item], n_docs: dict[tuple[str, ...], int], similarity: float) -> None:
        seeds = rare_seeds(items, n_docs, similarity)
        self.items, self.similarity = items, similarity
        self.index = {g: k for k, g in enumerate(seeds)}
        self.where = list(seeds.values())
        self.counts = [n_docs[g] for g in seeds]
        self.sizes = sorted({len(g) for g in seeds})
        self.memory = _Memory()

    def copies(self, text: str | None) -> Iterator[tuple[int, float, int, int, int]]:
        """(item_id, similarity, start_word, end_word, rarest_docs) of each stretch that copies an item."""
        words = words_of(text)
        by_item: dict[int, list[tuple[int, int]]] = {}
        for at, s in sorted(_found(words, self.index, self.sizes)):
            for k in self.where[s]:
                by_item.setdefault(k, []).append((at, s))
        for k, hits in by_item.items():
            item_id, item = self.items[k]
            reach = int(len(item) / self.similarity + 1e-9) + N
            first = 0
            for i in range(1, len(hits) + 1):  # hits too far apart for one copy belong to different stretches
                if i < len(hits) and hits[i][0] - hits[i - 1][0] <= reach:
                    continue
                ranked = [(self.counts[s], at) for at, s in hits[first:i]]
                first = i
                score, start, end = _best(words, k, item, ranked, self.similarity, self.memory)
                if score >= self.similarity - 1e-9:
                    yield item_id, score, start, end, min(ranked)[0]


def finders(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> Iterator[Finder]:
    """One for each block of items, once its seeds are counted over all of `docs`."""
    block: list[Item] = []
    size = 0

    def flush() -> Finder:
        grams = list(dict.fromkeys(g for _, words in block for g in _grams(list(words))))
        return Finder(list(block), {grams[k]: n for k, n in document_counts(docs, grams).items()}, similarity)

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():  # a block at a time
        w = tuple(words_of(r["text"]))
        if not w:
            continue
        if block and size + len(w) > MAX_SEEDS:
            yield flush()
            block, size = [], 0
        block.append((r["item_id"], w))
        size += len(w)
    if block:
        yield flush()


_NAMES = ["doc_id", "item_id", "similarity", "start_word", "end_word", "rarest_docs"]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
_MATCH = "doc_id long, item_id long, similarity double, start_word long, end_word long, rarest_docs long"


def _matches(docs: DataFrame, finder: Finder) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(finder)  # MAX_SEEDS seeds at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = shared.value.copies
        for batch in batches:
            out = [(doc_id, *c) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for c in copies(text.as_py())]
            columns = zip(*out) if out else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return _tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word, rarest_docs), a row for each stretch of a document that copies an item."""
    found = [_matches(docs, f) for f in finders(docs, benchmark, similarity)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, whose text copies no item: told where they lie, so that no row moves and no id decides."""
    place = docs.columns.index("text")
    out = docs
    for finder in finders(docs, benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(finder)  # MAX_SEEDS seeds at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            copies = shared.value.copies
            for batch in batches:
                yield batch.filter(pa.array([next(copies(t.as_py()), None) is None for t in batch.column(place)], pa.bool_()))

        out = _tasks(out, run, docs.schema)
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that copy a benchmark item go, each row told by its own text.

    A null or empty text copies nothing and stays; ids, null or repeated, decide nothing; repeated rows go or stay alike;
    an empty table gives an empty result; all columns come back, whatever their names.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}  # an alignment: tests hold it against brute force
