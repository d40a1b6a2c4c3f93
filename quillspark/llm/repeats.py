"""Removal of repeated byte strings by suffix arrays with common-prefix interval trees.

A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one of lowest hash (the leftmost of equals) is its anchor, wherever the
string occurs. So equal strings meet where their anchors meet, and a text falls into stretches of string starts with one anchor.
1. Each stretch is dealt by its anchor's hash as 43 bytes: a 128-bit hash of its context (all bytes that its strings cover) and its
   place. Stretches of equal contexts are repeats as a whole; within a batch they are recognised before anything is sent, so a
   passage in a third of all texts sends a row a batch.
2. Only where one anchor has different contexts are bytes fetched: one context of each kind. For each distance from the anchor the
   suffixes that start there form an array; a stack scan over the common prefixes of neighbours builds its interval tree. Intervals
   whose occurrences have different left neighbours (or reach a stretch's edge) are maximal repeats; they are put out with all
   their occurrences.
   An anchor with more than MANY different contexts (or, in the buckets that have more than MOST stretches, with more than MOST / 2
   stretches) would be too much for one task; its strings are hashed instead, one row a string, counted with map-side sums, and those
   that occur again are spans.
3. Spans are joined with the texts, merged and cut out.

Defined results: a null or empty text loses nothing; texts under LENGTH bytes have no such string; matches never cross texts;
repeated rows are removed as copies of each other; rows that share an id are told apart by their texts; a null id stays null;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import bucket_count, discard, few_rows, frugal, frugal_group, spool, table, text_rows
from quillspark.llm.shingles import mix

#: Bytes of a gram; texts are hashed in pieces of about so many bytes, which must be under 2**24.
GRAM, PIECE = 32, 1_500_000

#: Stretches that one task may get, and different contexts of one anchor.
MOST, MANY = 2_000_000, 20_000

#: ctx, more: the two halves of the hash of a context.
ENTRY = np.dtype([("anchor", "<u8"), ("ctx", "<u8"), ("more", "<u8"), ("w", "u1"), ("off", "u1"), ("flag", "u1"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<u4")])
FOUND = "doc long, tag int, at long, stop long, w int, off int, anchor long, many boolean"
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all grams of `size` bytes, a power of two, by doubling."""
    h, step, power = mix(raw.astype(np.uint64) + np.uint64(1)), 1, _BASE
    while step < size:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % 2**64, 2 * step
    return mix(h)


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes its anchor's place, and all grams' hashes."""
    h = gram_hashes(raw)
    window = length - GRAM + 1
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    low, step = key, 1
    while step * 2 <= window:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < window:
        low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64), h


def _stretches(ids: list, tags: list, texts: list[bytes], first: list[int], length: int) -> np.ndarray:
    """Entries of the pieces of texts; first: where each piece starts in its text."""
    import xxhash

    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    at, h = anchors(raw, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[: len(at)]
    start = np.arange(len(at))
    valid = start + length <= ends[owner]
    start, at, owner = start[valid], at[valid], owner[valid]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
    s, a, o = start[new], at[new], owner[new]
    w = np.diff(np.concatenate([new, [len(start)]]))
    out = np.zeros(len(s), ENTRY)
    digest, stop = xxhash.xxh3_128_digest, (s + w - 1 + length).tolist()
    halves = np.frombuffer(b"".join(digest(joined[b:e]) for b, e in zip(s.tolist(), stop, strict=True)), ">u8")
    out["ctx"], out["more"] = halves[::2], halves[1::2]
    out["anchor"], out["w"], out["off"] = h[a], w, a - s
    out["doc"], out["tag"] = np.array(ids, np.int64)[o], np.array(tags, np.int32)[o]
    out["at"] = s - (ends - sizes)[o] + np.array(first, np.int64)[o]
    return out


def _same(e: np.ndarray) -> np.ndarray:
    """Whether a sorted entry's predecessor has the same anchor and context."""
    return _and_first(np.logical_and.reduce([e[c][1:] == e[c][:-1] for c in ("anchor", "ctx", "more", "w", "off")]), len(e))


def _and_first(later: np.ndarray, n: int, first: bool = False) -> np.ndarray:
    """later, for all but the first of n, with what holds for the first."""
    return np.concatenate([[first], later])[:n].astype(bool)


def _sorted(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["at"], e["doc"], e["off"], e["w"], e["more"], e["ctx"], e["anchor"]))]


def _settled(e: np.ndarray, length: int) -> np.ndarray:
    """Of a batch's entries one of each context goes on, flagged 1 if it has copies here. The copies' spans go on too, as entries
    flagged 2 with their end in ctx, put together where they overlap."""
    e = _sorted(e)
    same = _same(e)
    again = same | np.append(same[1:], False)[: len(e)]
    e["flag"] = again
    done = e[again]
    done = done[np.lexsort((done["at"], done["tag"], done["doc"]))]
    if len(done):
        stop = done["at"].astype(np.int64) + done["w"] - 1 + length
        fresh = np.concatenate([[True], (done["doc"][1:] != done["doc"][:-1]) | (done["tag"][1:] != done["tag"][:-1]) | (done["at"][1:] > stop[:-1])])
        last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(done) - 1]])
        stop = stop[last]
        done = done[fresh]
        done["ctx"], done["flag"], done["anchor"] = stop, 2, mix(done["doc"].astype(np.uint64))
    return np.concatenate([e[~same], done])


def _dealt(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def drain(entries: list[np.ndarray]) -> pa.RecordBatch:
            e = _settled(np.concatenate(entries), length) if entries else np.zeros(0, ENTRY)
            bucket = (e["anchor"] & np.uint64(buckets - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "entries": pa.array([e[cuts[b] : cuts[b + 1]].tobytes() for b in own], pa.binary())})

        for pieces in _pieces(batches, length):
            held.append(_stretches(*pieces, length))
            size += len(held[-1])
            if size >= 400_000:
                yield drain(held)
                held, size = [], 0
        yield drain(held)

    return rows.mapInArrow(frugal(run), "bucket int, entries binary")


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, list[bytes], list[int]]]:
    """Texts by about PIECE bytes; a longer text in pieces that overlap by a byte less than a string."""
    ids, tags, texts, first, size = [], [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            for doc, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for k in range(0, max(1, len(text) - length + 1), PIECE):
                    part = text[k : k + PIECE + length - 1]
                    if len(part) < length:
                        continue
                    ids.append(doc), tags.append(tag), texts.append(part), first.append(k)
                    size += len(part)
                    if size >= PIECE:
                        yield ids, tags, texts, first
                        ids, tags, texts, first, size = [], [], [], [], 0
    if ids:
        yield ids, tags, texts, first


def _met(length: int):
    def run(group: pa.Table) -> pa.Table:
        """Spans (w = 0) of contexts that occur again, and one stretch (w > 0) of each context where an anchor has several."""
        e = np.frombuffer(b"".join(group.column("entries").to_pylist()), ENTRY)
        spans = e[e["flag"] == 2]
        e = _sorted(e[e["flag"] < 2])
        same = _same(e)
        again = same | np.append(same[1:], False)[: len(e)]
        known = e[again & (e["flag"] == 0)]
        kinds = e[~same]
        anchor = kinds["anchor"]
        several = _and_first(anchor[1:] == anchor[:-1], len(kinds))
        several = several | np.append(several[1:], False)[: len(kinds)]
        kinds = kinds[several]
        _, group, held = np.unique(kinds["anchor"], return_inverse=True, return_counts=True)
        many = held[group] > MANY if len(kinds) else np.zeros(0, bool)
        at = np.concatenate([spans["at"], known["at"], kinds["at"]]).astype(np.int64)
        stop = np.concatenate([spans["ctx"].astype(np.int64), known["at"].astype(np.int64) + known["w"] - 1 + length, kinds["at"].astype(np.int64) + kinds["w"] - 1 + length])
        n = len(spans) + len(known)
        return pa.table({
            "doc": np.concatenate([x["doc"] for x in (spans, known, kinds)]), "tag": np.concatenate([x["tag"] for x in (spans, known, kinds)]), "at": at, "stop": stop,
            "w": np.concatenate([np.zeros(n, np.int32), kinds["w"].astype(np.int32)]), "off": np.concatenate([np.zeros(n, np.int32), kinds["off"].astype(np.int32)]),
            "anchor": np.concatenate([np.zeros(n, np.int64), kinds["anchor"].view(np.int64)]), "many": np.concatenate([np.zeros(n, bool), many]),
        })

    return run


def _common(a: bytes, b: bytes, least: int) -> int:
    """Length of the common prefix, 0 if it is under `least`."""
    if a[:least] != b[:least] or min(len(a), len(b)) < least:
        return 0
    low, high = least, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def interval_tree(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of a suffix array with a common prefix of depth > 0, inner ones first, by a stack scan.
    prefixes[i] is the common prefix of the suffixes at i - 1 and i; prefixes[0] is 0."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for i, depth in enumerate([*prefixes[1:], 0], 1):
        first = i - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(contexts: list[tuple[bytes, int, int]], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(depth, occurrences) of the maximal repeats of `length` bytes or more among contexts of one anchor, given as (bytes, number of
    string starts, place of the anchor); an occurrence is (context, start)."""
    low = min(off - w + 1 for _, w, off in contexts)
    for distance in range(max(off for _, _, off in contexts), low - 1, -1):
        own = [(text[off - distance :], i) for i, (text, w, off) in enumerate(contexts) if 0 <= off - distance < w]
        if len(own) < 2:
            continue
        own.sort()
        prefixes = [0] + [_common(a[0], b[0], length) for a, b in zip(own[:-1], own[1:], strict=True)]
        for depth, first, last in interval_tree(prefixes):
            places = [(i, contexts[i][2] - distance) for _, i in own[first : last + 1]]
            before = {contexts[i][0][p - 1 : p] if p else b"" for i, p in places}
            if len(before) > 1 or b"" in before:
                yield depth, places


def _compared(length: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("anchor", "doc", "tag", "at", "w", "off", "bytes")), strict=True), key=lambda r: r[0])
        out: dict[str, list] = {"doc": [], "tag": [], "at": [], "stop": []}
        i = 0
        while i < len(rows):
            k = i
            while k < len(rows) and rows[k][0] == rows[i][0]:
                k += 1
            own = rows[i:k]
            best: dict[tuple[int, int], int] = {}
            for depth, places in maximal_repeats([(r[6], r[4], r[5]) for r in own], length):
                for c in places:
                    best[c] = max(depth, best.get(c, 0))
            for (c, p), depth in best.items():
                out["doc"].append(own[c][1]), out["tag"].append(own[c][2]), out["at"].append(own[c][3] + p), out["stop"].append(own[c][3] + p + depth)
            i = k
        return pa.table({"doc": pa.array(out["doc"], pa.int64()), "tag": pa.array(out["tag"], pa.int32()), "at": pa.array(out["at"], pa.int64()), "stop": pa.array(out["stop"], pa.int64())})

    return run


_OPEN = "anchor long, ctx long, more long, w int, off int, flag int, doc long, tag int, at long"


def _opened(dealt: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                e = np.frombuffer(raw, ENTRY)
                kinds = {"anchor": np.int64, "ctx": np.int64, "more": np.int64, "w": np.int32, "off": np.int32, "flag": np.int32, "doc": np.int64, "tag": np.int32, "at": np.int64}
                yield pa.RecordBatch.from_pydict({c: e[c].astype(k) for c, k in kinds.items()})

    return dealt.select("entries").mapInArrow(run, _OPEN)


def _closed(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.zeros(b.num_rows, ENTRY)
            for c in ENTRY.names:
                x = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                e[c] = x.view(np.uint64) if x.dtype == np.int64 else x
            bucket = (e["anchor"] & np.uint64(buckets - 1)).astype(np.int32)
            own = np.unique(bucket)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "entries": pa.array([e[bucket == k].tobytes() for k in own], pa.binary())})

    return rows.select(*ENTRY.names).mapInArrow(run, "bucket int, entries binary")


def _apart(dealt: DataFrame, big: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(dealt without the anchors that have too many stretches, the stretches of those)."""
    opened = _opened(dealt.join(few_rows(big), "bucket", "left_semi"))
    hot = few_rows(spool(opened.where("flag < 2").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST // 2).select("anchor"), "hot"))
    rest = dealt.join(few_rows(big), "bucket", "left_anti").select("bucket", "entries")
    return rest.union(_closed(opened.join(hot, "anchor", "left_anti"), buckets)), opened.where("flag < 2").join(hot, "anchor", "left_semi")


def _hashed(rows: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """(doc, tag, at, stop) of the strings of hot stretches that occur again, by 128-bit hashes of the strings."""
    asked = hot.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "w", "flag")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - 2**64 if x >= 2**63 else x
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("h1", "h2", "doc", "tag", "at", "n")}
            for doc, tag, text, each in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                for x in each:
                    for at in range(x["at"], x["at"] + x["w"]):
                        h = xxhash.xxh3_128_intdigest(text[at : at + length])
                        for c, v in zip(out, (signed(h >> 64), signed(h & (2**64 - 1)), doc, tag, at, 1 + (x["flag"] == 1)), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("at", pa.int64()), ("n", pa.int32())]))

    texts = rows.join(asked, (rows.key == asked.doc) & (rows.tag == asked.tag)).select(rows.key, rows.tag, rows.text, "asked")
    strings = spool(texts.mapInArrow(run, "h1 long, h2 long, doc long, tag int, at long, n int"), "strings")
    again = strings.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2")
    return strings.join(again, ["h1", "h2"], "left_semi").select("doc", "tag", "at", (F.col("at") + length).alias("stop"))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(doc, tag, at, stop) in bytes, overlapping, of all repeated strings of rows (key long, tag int, text)."""
    buckets = bucket_count(rows)
    dealt, hot = spool(_dealt(rows, length, buckets), "dealt"), None
    big = spool(dealt.groupBy("bucket").agg(F.sum(F.length("entries") / ENTRY.itemsize).alias("n")).where(F.col("n") > MOST).select("bucket"), "big")
    if not big.isEmpty():
        dealt, hot = _apart(dealt, big, buckets)
    found = spool(dealt.groupBy("bucket").applyInArrow(frugal_group(_met(length)), FOUND), "found")
    if hot is None:
        discard(dealt, big)
    crowded = found.where("many").select("doc", "tag", "at", "w", F.lit(0).alias("flag"))
    if not crowded.isEmpty():
        crowded = _hashed(rows, crowded, length)
        hot = _hashed(rows, hot, length).union(crowded) if hot is not None else crowded
    elif hot is not None:
        hot = _hashed(rows, hot, length)
    asked = found.where("w > 0 and not many").groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "at", "stop", "w", "off")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "doc", "tag", "at", "w", "off", "bytes")}
            for doc, tag, text, each in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                for x in {(x["anchor"], x["at"], x["stop"], x["w"], x["off"]) for x in each}:
                    for c, v in zip(out, (x[0], doc, tag, x[1], x[3], x[4], text[x[1] : x[2]]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("at", pa.int64()), ("w", pa.int32()), ("off", pa.int32()), ("bytes", pa.binary())]))

    texts = rows.join(asked, (rows.key == asked.doc) & (rows.tag == asked.tag)).select(rows.key, rows.tag, rows.text, "asked").dropDuplicates(["key", "tag"])
    contexts = texts.mapInArrow(frugal(cut), "anchor long, doc long, tag int, at long, w int, off int, bytes binary")
    differing = contexts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets))).applyInArrow(frugal_group(_compared(length)), "doc long, tag int, at long, stop long")
    spans = found.where("w = 0").select("doc", "tag", "at", "stop").union(differing)
    return spans if hot is None else spans.union(hot)


def cut_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array of at and stop, merged and in order, kept binary) for every row of docs."""
    rows = text_rows(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.xxhash64("text")).alias("key"), F.hash("text").alias("tag"), "text")
    spans = repeated_spans(rows.select("key", "tag", "text"), length)
    spans = spans.groupBy("doc", F.col("tag").alias("t")).agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
    joined = rows.join(spans, (rows.key == spans.doc) & (rows.tag == spans.t), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                merged, kept, sizes = [], [], []
                for text, own in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for at, stop in sorted((x["at"], x["stop"]) for x in own or []):
                        if runs and at <= runs[-1][1]:
                            runs[-1][1] = max(stop, runs[-1][1])
                        else:
                            runs.append([at, stop])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    merged.append([{"at": a, "stop": z} for a, z in runs])
                    kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(frugal(run), f"{id_col} long, n_bytes long, spans array<struct<at:long,stop:long>>, kept binary")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["at"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
