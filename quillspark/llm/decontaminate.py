"""Benchmark decontamination by greedy string tiling.

Words are runs of characters that are neither white space nor ASCII punctuation, A-Z lower-cased.
1. Seeds: a running Karp-Rabin hash of every LEAST words. Seeds of documents are joined with those of the benchmark's items; a filter
   of hash slots, made of the items' seeds, keeps others from being sent. A document and an item are a candidate if they share so
   many seeds as the coverage asked for takes at least.
2. Each candidate is tiled: for a search length that is halved down to LEAST, all longest common runs of unmarked words are found by
   the running hashes, the longest is taken as a tile after its words have been compared, and its words are marked in item and
   document. The tiles' share of the item's words is its coverage, in whatever order the tiles stand in the document.

Only runs that can't be made longer to the left are listed, so texts that repeat few words cost about their number of words.
Candidates and the items are broadcast where their number (for items, their characters) is counted to be small, else joined by key;
each document's text is read twice, whatever the size of the benchmark.

Defined results: a null or empty text or item has no words and no match; an item of fewer than LEAST words matches a document that
consists of the same words only; null ids are kept as they are; repeated rows and items give repeated results; texts are read
whole; of equally long matches the first in the item, then in the document, is taken; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import few_rows, frugal, spool, table, text_rows
from quillspark.llm.shingles import CHUNK_BYTES, mix, word_hashes

#: Words of a seed, and so of the shortest tile; share of an item's words that makes a document contaminated.
LEAST, COVERAGE = 5, 0.6
#: Characters of items that are broadcast.
BROADCAST_CHARS = 16_000_000
#: Bits of a seed's slot in the filter at most, so the filter has 2 MB at most; a fuller filter lets more seeds through to the join.
SLOT_BITS = 24

_PLAIN = bytes(0x20 if (c < 0x80 and not chr(c).isalnum()) else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text."""
    chunk, size = [], 0
    for t in [*texts, None]:
        if t is None or (chunk and size + len(t) > CHUNK_BYTES):
            if chunk:
                h, offsets = word_hashes(chunk)
                yield from (h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            chunk, size = [], 0
        if t is not None:
            chunk.append(t.translate(_PLAIN))
            size += len(t)


class Rolling:
    """The words of a text with running sums, from which the Karp-Rabin hash of any run of words follows in one step."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        if len(Rolling._powers[0]) <= self.n:
            Rolling._powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * self.n, x, np.uint64))]) for x in (_BASE, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * Rolling._powers[0][: self.n])])

    def runs(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * Rolling._powers[1][at]

    def seeds(self, least: int) -> np.ndarray:
        """Distinct hashes of runs of `least` words and how often each occurs; of fewer words the whole is one."""
        size = min(least, self.n)
        return np.unique(mix(self.runs(np.arange(self.n - size + 1), size) + np.uint64(size)), return_counts=True) if self.n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _next(marked: np.ndarray) -> np.ndarray:
    """For each place the first marked one that isn't before it, or the end."""
    n = len(marked)
    return np.minimum.accumulate(np.where(marked, np.arange(n), n)[::-1])[::-1]


def _starts(text: Rolling, marked: np.ndarray, size: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of unmarked runs, their hashes, and the word before each (`edge`, if there is none or it is marked)."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(sums[size:] == sums[:-size])
    free = (at > 0) & ~marked[at - 1]
    return at, text.runs(at, size), np.where(free, text.words[at - 1], np.uint64(edge))


def _matches(a: Rolling, b: Rolling, marked: tuple[np.ndarray, np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """(-words, place in a, place in b) of all longest common runs of unmarked words of `size` or more."""
    (ia, ha, pa_), (ib, hb, pb) = _starts(a, marked[0], size, 1), _starts(b, marked[1], size, 2)
    both = np.intersect1d(ha, hb)
    if not len(both):
        return []
    sides = []
    for at, h, before in ((ia, ha, pa_), (ib, hb, pb)):
        k = np.minimum(np.searchsorted(both, h), len(both) - 1)
        own = both[k] == h
        order = np.argsort(k[own], kind="stable")
        k, at, before = k[own][order], at[own][order], before[own][order]
        sides.append((at, before, np.searchsorted(k, np.arange(len(both) + 1))))
    (at_a, before_a, cut_a), (at_b, before_b, cut_b) = sides
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    few = n_a * n_b <= 64
    k = np.flatnonzero(few)
    pairs = n_a[k] * n_b[k]
    within = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    wide = np.repeat(n_b[k], pairs)
    x, y = np.repeat(cut_a[k], pairs) + within // wide, np.repeat(cut_b[k], pairs) + within % wide
    found = [(x, y)]
    for k in np.flatnonzero(~few):  # a run that many places have: only pairs of places with different words before them
        xs, ys = np.arange(cut_a[k], cut_a[k + 1]), np.arange(cut_b[k], cut_b[k + 1])
        for word in np.unique(before_a[xs]):
            own, others = xs[before_a[xs] == word], ys[before_b[ys] != word]
            found.append((np.repeat(own, len(others)), np.tile(others, len(own))))
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    longest = before_a[x] != before_b[y]
    i, j = at_a[x[longest]], at_b[y[longest]]
    low, high = np.full(len(i), size), np.minimum(_next(marked[0])[i] - i, _next(marked[1])[j] - j)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.runs(i, middle) == b.runs(j, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return list(zip((-low).tolist(), i.tolist(), j.tolist(), strict=True))


def tiles(a: Rolling, b: Rolling, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling: tiles (place in a, place in b, words), the longest first."""
    marked = np.zeros(a.n, bool), np.zeros(b.n, bool)
    out: list[tuple[int, int, int]] = []
    if min(a.n, b.n) < least:
        return out
    size = least << (min(a.n, b.n) // least).bit_length() - 1
    while size >= least:
        heap = _matches(a, b, marked, size)
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            n = -n
            taken = marked[0][i : i + n] | marked[1][j : j + n] | (a.words[i : i + n] != b.words[j : j + n])
            if not taken.any():
                out.append((i, j, n))
                marked[0][i : i + n] = marked[1][j : j + n] = True
                if marked[0].sum() > a.n - size:
                    break
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))  # what is left of it goes back, in runs
            for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if stop - first >= size:
                    heapq.heappush(heap, (first - stop, i + first, j + first))
        size //= 2
        if marked[0].sum() > a.n - least:
            break
    return out


def _seeds_of_items(texts: DataFrame, least: int, threshold: float) -> DataFrame:
    """(seed, item, places, need): seeds of each text, in how many places it has them, and in how many a document must share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, w in zip(b.column(0).to_pylist(), words(b.column(1).cast(pa.binary()).to_pylist()), strict=True):
                seeds, places = Rolling(w).seeds(least)
                need = max(1, int(np.ceil(threshold * len(w) / least - 1e-9))) if len(w) >= least else 1
                yield pa.RecordBatch.from_pydict({"seed": seeds.view(np.int64), "item": np.full(len(seeds), key, np.int64), "places": places.astype(np.int32), "need": np.full(len(seeds), need, np.int32)})

    return texts.mapInArrow(run, "seed long, item long, places int, need int")


def _shared_seeds(rows: DataFrame, least: int, slots: np.ndarray, bits: int) -> DataFrame:
    """(seed, doc): distinct seeds of each text whose slot is one of the items'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        held[slots] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                keys, seeds = [], []
                for key, w in zip(b.column(0).to_pylist(), words(b.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    size = min(least, len(w))
                    if size:
                        text = Rolling(w)
                        h = mix(text.runs(np.arange(text.n - size + 1), size) + np.uint64(size))
                        h = np.unique(h[held[(h & np.uint64((1 << bits) - 1)).astype(np.int64)]])
                        keys.append(np.full(len(h), key, np.int64)), seeds.append(h)
                if keys:
                    yield pa.RecordBatch.from_pydict({"seed": np.concatenate(seeds).view(np.int64), "doc": np.concatenate(keys)})

    return rows.mapInArrow(frugal(run), "seed long, doc long")


def candidates(rows: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """(doc, item): keys of texts that share enough seeds; rows and items are (key, text)."""
    seeds = spool(_seeds_of_items(items.distinct(), least, threshold), "item-seeds")
    bits = min(SLOT_BITS, max(16, (16 * seeds.count()).bit_length()))
    slots = seeds.select(F.expr(f"seed & {(1 << bits) - 1}").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    shared = _shared_seeds(rows, least, slots, bits).join(few_rows(seeds), "seed")
    return shared.groupBy("doc", "item", "need").agg(F.sum("places").alias("places")).where("places >= need").select("doc", "item")


def coverage(docs: DataFrame, items: DataFrame, least: int = LEAST, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, item_id, n_tiles, n_covered, n_words, coverage) of each document and item with a coverage of `threshold` or more."""
    rows = text_rows(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64("text").alias("doc"), "text")
    own = spool(items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("other")).withColumn("item", F.xxhash64("other")), "items")
    found = few_rows(spool(candidates(rows.select("doc", "text"), own.select("item", "other"), least, threshold), "candidates"))
    chars = own.agg(F.coalesce(F.sum(F.octet_length("other")), F.lit(0)).alias("n")).first()["n"]
    pairs = rows.join(found, "doc").join(F.broadcast(own) if chars <= broadcast_chars else own, "item")
    names = [id_col, "item_id", "n_tiles", "n_covered", "n_words", "coverage"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Rolling] | None = None
        for b in batches:
            out: list[tuple] = []
            for doc, item, text, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)), strict=True):
                if last is None or last[0] != text:
                    last = text, Rolling(next(words([text])))
                w = last[1]
                x = Rolling(next(words([other])))
                done = [(0, 0, x.n)] if 0 < x.n < least and np.array_equal(x.words, w.words) else tiles(x, w, least)
                n = sum(size for _, _, size in done)
                if n and n >= threshold * x.n:
                    out.append((doc, item, len(done), n, x.n, n / x.n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return pairs.select("id", "item_id", "text", "other").mapInArrow(frugal(run), f"{id_col} long, item_id long, n_tiles int, n_covered int, n_words int, coverage double")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
