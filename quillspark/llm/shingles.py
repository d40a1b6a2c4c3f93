"""Word shingles as sets of 64-bit hashes, and exchanges of such sets packed by bucket of the hash.

Hashes are computed by numpy over whole batches of text. Two different shingles share a 64-bit hash with a probability of
about 5e-20, so that sizes of sets and of intersections are exact for all practical purposes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACES = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(0, n - 1), _BASE, U64))])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased), and the offsets of each text's words."""
    raw = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    word = ~space
    first = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    after = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, U64), offsets
    sizes = after - first
    starts = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    sums = np.add.reduceat(_BYTE[raw[word]] * _powers(int(sizes.max()))[within], starts)
    return mix(sums + sizes.astype(U64) * U64(0xD6E8FEB86659FD93)), offsets


def sequences(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    if len(h) < size:
        return np.zeros(0, U64)
    total = np.zeros(len(h) - size + 1, U64)
    for i in range(size):
        total += h[i : len(h) - size + 1 + i] * _PLACES[i % 64]
    return mix(total + U64(size))


def document_shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: with fewer words the whole sequence is one, without words there are none."""
    chunk, total = [], 0
    for t in texts + [None]:
        if t is None or (chunk and total + len(t) > CHUNK_BYTES):
            if chunk:
                h, offsets = word_hashes(chunk)
                s = sequences(h, size)
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    if b - a >= size:
                        yield np.unique(s[a : b - size + 1])
                    elif b > a:
                        yield sequences(h[a:b], int(b - a))
                    else:
                        yield np.zeros(0, U64)
            chunk, total = [], 0
        if t is not None:
            chunk.append(t)
            total += len(t)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()), int(mix(s + U64(0x14057B7EF767814F)).sum())
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return signed(a % 2**64), signed(b % 2**64)


def squeeze(x: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers (with `steps` their differences, for ascending ones) as a base, a width and so many bytes each of what exceeds the
    base, the lowest bytes of all of them first."""
    if not len(x):
        return b""
    x = x.astype(np.int64).view(U64)
    base = x[0] if steps else x.view(np.int64).min().view(U64)
    x = np.diff(x, prepend=base) if steps else x - base
    width = (int(x.max()).bit_length() + 7) // 8
    return base.tobytes() + bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + (b"" if width else len(x).to_bytes(8, "little"))


def expand(b: bytes, steps: bool = False) -> np.ndarray:
    """What squeeze() was given, as 64-bit integers."""
    if not b:
        return np.zeros(0, np.int64)
    base, width = np.frombuffer(b, U64, 1)[0], b[8]
    if not width:
        return np.full(int.from_bytes(b[9:], "little"), base, U64).view(np.int64)
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, :width] = planes.T
    x = x.reshape(-1).view(U64)
    return ((np.cumsum(x, dtype=U64) if steps else x) + base).view(np.int64)


class Packer:
    """Gathers (id, size, hashes) of documents and deals the hashes to buckets by their low bits, a row a bucket.

    A hash that several of the gathered documents have is settled here: it goes on once, with their number, and each of them is noted
    in `local`. So of any hash, however common, a packer sends one entry each time it is drained."""

    def __init__(self, buckets: int, width: type = np.uint32, limit: int = 1_000_000):
        self.buckets, self.width, self.limit = buckets, width, limit
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.sets, self.held = [], [], [], 0

    def add(self, doc: int, size: int, hashes: np.ndarray) -> bool:
        """True when it is time to drain."""
        self.ids.append(doc), self.sizes.append(size), self.sets.append(hashes)
        self.held += len(hashes)
        return self.held >= self.limit

    def row(self, rows: dict[str, list], bucket: int, **arrays: np.ndarray) -> None:
        rows["bucket"].append(int(bucket))
        for c in _BYTES:
            rows[c].append(b"" if c not in arrays else arrays[c].tobytes() if c in _HASHES else squeeze(arrays[c], c == "docs"))

    def drain(self) -> tuple[dict[str, list], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows to send, local). local: ids and sizes of documents, how many of their hashes others here have too, those hashes."""
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int32)
        by = np.argsort(ids, kind="stable")  # so that ids go on as small steps
        ids, sizes, sets = ids[by], sizes[by], [self.sets[i] for i in by]
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        doc = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
        self.clear()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(flat)])
        n = np.diff(np.concatenate([first, [len(flat)]]))
        many = np.zeros(len(flat), bool)
        many[order] = np.repeat(n > 1, n)
        own, counts = np.unique(doc[many], return_counts=True)
        local = ids[own], sizes[own], counts, flat[many]
        rows: dict[str, list] = {c: [] for c in ("bucket", *_BYTES)}
        self._put(rows, ids, sizes, doc[~many], flat[~many])
        common, times = ordered[first[n > 1]], n[n > 1]
        bucket = (common & U64(self.buckets - 1)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = by[cuts[b] : cuts[b + 1]]
            self.row(rows, b, common=self._short(common[part]), times=times[part])
        return rows, local

    def _short(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(20)).astype(np.uint32) if self.width is np.uint32 else hashes

    def _put(self, rows: dict[str, list], ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, flat: np.ndarray) -> None:
        bucket = (flat & U64(self.buckets - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        doc, bucket, flat = doc[order], bucket[order], self._short(flat[order])
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            d = doc[cuts[b] : cuts[b + 1]]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            counts = np.diff(np.concatenate([new, [len(d)]]))
            self.row(rows, b, docs=ids[d[new]], sizes=sizes[d[new]], counts=counts, tokens=flat[cuts[b] : cuts[b + 1]])


#: Hashes go on as they are, the rest goes through squeeze(). docs: ids; sizes: theirs; counts: how many tokens each has here; tokens: all of them; common: tokens of several; times: of how many.
_BYTES = ("docs", "sizes", "counts", "tokens", "common", "times")
_HASHES = ("tokens", "common")
PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in _BYTES)


def packed(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _BYTES)]))


def unpack(table: pa.Table, width: type = np.uint32) -> dict[str, np.ndarray]:
    """All rows of a bucket together."""
    kinds = {"sizes": np.int32, "counts": np.uint32, "times": np.uint32}
    parts = {c: table.column(c).to_pylist() for c in _BYTES}
    hashes = {c: np.frombuffer(b"".join(parts[c]), width) for c in _HASHES}
    return hashes | {c: np.concatenate([np.zeros(0, np.int64), *(expand(b, c == "docs") for b in parts[c])]).astype(kinds.get(c, np.int64)) for c in _BYTES if c not in _HASHES}
