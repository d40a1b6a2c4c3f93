"""Byte-level BPE encoding and decoding by recursive queries of DuckDB inside each partition.

Each pre-token ("word") is a set of rows (word, position, token). The recursive query joins neighbouring tokens with the
merge table, finds each word's leftmost pair of lowest rank, contracts it, and repeats until no word has a pair left. An
aggregate ordered by position turns ids back into bytes. Words are encoded once per batch and looked up afterwards.

The query holds every step, so a word costs the square of its bytes. Words of more than LONG_WORD bytes are contracted by a heap of
their pairs instead, in the same order: lowest rank first, leftmost of equals. Words of one query are dealt so that its steps have
at most QUERY_ROWS rows.

Defined results: a null or empty text has no tokens and decodes to the empty string; a null id stays null; repeated rows
give repeated results; texts and words of any length are encoded whole, in slices of words; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.base import KEPT, frugal, table, text_rows

#: Words of more bytes than this (255 at most) are contracted by a heap.
LONG_WORD = 64
#: Rows of all steps of one recursive query, characters of text for one batch, words of a long text for one slice, and words that are
#: remembered.
QUERY_ROWS, BATCH_CHARS, SLICE_WORDS, KEPT_WORDS = 1_500_000, 400_000, 100_000, 300_000

#: A row's key g is its word's number and, in the low 8 bits, its position; ng and nt are the key and token of the row behind it.
_ENCODE = """
WITH RECURSIVE enc AS (
  SELECT (w::BIGINT << 8) | pos AS g, tok, lead((w::BIGINT << 8) | pos) OVER s AS ng, lead(tok) OVER s AS nt, 0 AS step
  FROM words WINDOW s AS (ORDER BY (w::BIGINT << 8) | pos)
  UNION ALL
  (WITH best AS (
     SELECT g >> 8 AS w, min((m.rank::BIGINT << 8) | (g & 255)) AS k, arg_min(ng, (m.rank::BIGINT << 8) | (g & 255)) AS gone
     FROM enc JOIN merges m ON m.l = enc.tok AND m.r = enc.nt WHERE ng >> 8 = g >> 8 GROUP BY 1)
   SELECT g, tok, lead(g) OVER s AS ng, lead(tok) OVER s AS nt, step FROM (
     SELECT e.g, CASE WHEN (e.g & 255) = (b.k & 255) THEN (b.k >> 8)::INT ELSE e.tok END AS tok, e.step + 1 AS step
     FROM enc e JOIN best b ON b.w = e.g >> 8 WHERE e.g <> b.gone) WINDOW s AS (ORDER BY g)))
SELECT (g >> 8)::INT AS w, tok FROM enc JOIN (SELECT g >> 8 AS w, max(step) AS last FROM enc GROUP BY 1) l ON l.w = g >> 8 AND l.last = step ORDER BY g
"""

_DECODE = "SELECT unhex(string_agg(t.hex, '' ORDER BY pos)) AS bytes FROM ids JOIN vocab t ON t.tok = ids.tok GROUP BY w ORDER BY w"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Runs:
    """A growing list of arrays, kept as one array and their sizes."""

    def __init__(self, kind: type):
        self.flat, self.starts, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """parts: (arrays one after another, their sizes)."""
        self.flat = np.concatenate([self.flat, *(p[0] for p in parts)])
        self.sizes = np.concatenate([self.sizes, *(p[1] for p in parts)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def at(self, places: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.starts[places], self.sizes[places])


class WordEncoder:
    """Ids and decoded bytes of words, by DuckDB; remembers a bounded number of words."""

    def __init__(self, ranks: dict[bytes, int], memory_limit: str = "200MB"):
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory_limit, "temp_directory": "", "allocator_flush_threshold": "8MB", "allocator_bulk_deallocation_flush_threshold": "8MB"})
        left, right, rank = [], [], []
        for token, k in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(k)
        self.merges = np.array(left, np.int32), np.array(right, np.int32), np.array(rank, np.int32)
        self._put("merges", **dict(zip(("l", "r", "rank"), self.merges, strict=True)))
        self._put("vocab", tok=pa.array(list(ranks.values()), pa.int32()), hex=[t.hex() for t in ranks])
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pairs: dict[int, int] = {}
        self.forget()

    def _put(self, name: str, **columns) -> None:
        self.db.register("_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _in")
        self.db.unregister("_in")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bytes = Runs(np.uint32), Runs(np.uint8)

    def _rows(self, name: str, sizes: np.ndarray, tok: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        self._put(name, w=np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), pos=pos.astype(np.int32), tok=tok.astype(np.int32))

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        self._rows("words", np.array([len(b) for b in words], np.int64), self.byte[np.frombuffer(b"".join(words), np.uint8)])
        got = self.db.sql(_ENCODE).to_arrow_table()
        return got["tok"].to_numpy().astype(np.uint32), np.bincount(got["w"].to_numpy(), minlength=len(words))

    def _contracted_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, by a heap of (rank, place) of its pairs; what has changed since it was put there is passed over."""
        if not self.pairs:
            left, right, rank = self.merges
            self.pairs = dict(zip(((left.astype(np.int64) << 32) | right).tolist(), rank.tolist(), strict=True))
        find = self.pairs.get
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), 0xFFFFFFFF
        heap = [(r << 32) | i for i in range(n - 1) if (r := find((tok[i] << 32) | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k = heapq.heappop(heap)
            rank, i = k >> 32, k & low
            j = after[i]
            if j >= n or tok[i] < 0 or find((tok[i] << 32) | tok[j]) != rank:
                continue
            tok[i], tok[j] = rank, -1
            a, b = before[i], after[j]
            after[i] = b
            if b < n:
                before[b] = i
                if (r := find((rank << 32) | tok[b])) is not None:
                    heapq.heappush(heap, (r << 32) | i)
            if a >= 0 and (r := find((tok[a] << 32) | rank)) is not None:
                heapq.heappush(heap, (r << 32) | a)
        out = np.array(tok, np.int64)
        return out[out >= 0].astype(np.uint32)

    def _decoded(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids, one after another, and how many each has."""
        self._rows("ids", sizes, ids)
        got = self.db.sql(_DECODE).to_arrow_table()["bytes"].combine_chunks().cast(pa.large_binary())
        got = pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got
        places = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        raw = np.frombuffer(got.buffers()[2] or b"", np.uint8)[places[0] : places[-1]] if len(got) else np.zeros(0, np.uint8)
        return raw, np.diff(places)

    def learn(self, words: set[str]) -> None:
        """Encodes those words that aren't known yet."""
        new = [(b, w) for w in words if w not in self.known for b in (w.encode(),)]
        whole = [(b, w) for b, w in new if b in self.ranks]
        rest = sorted(((b, w) for b, w in new if b not in self.ranks), key=lambda x: len(x[0]))
        parts: list[tuple[list, np.ndarray, np.ndarray]] = []
        if whole:
            parts.append((whole, np.array([self.ranks[b] for b, _ in whole], np.uint32), np.ones(len(whole), np.int64)))
        at = 0
        while at < len(rest) and len(rest[at][0]) <= LONG_WORD:
            stop, rows = at, 0
            while stop < len(rest) and (size := len(rest[stop][0])) <= LONG_WORD and (stop == at or rows + size * size // 2 <= QUERY_ROWS):
                stop, rows = stop + 1, rows + size * size // 2
            parts.append((rest[at:stop], *self._contracted([b for b, _ in rest[at:stop]])))
            at = stop
        for b, w in rest[at:]:
            ids = self._contracted_long(b)
            parts.append(([(b, w)], ids, np.array([len(ids)], np.int64)))
        first = len(self.ids.sizes)
        self.ids.extend([(ids, sizes) for _, ids, sizes in parts])
        self.bytes.extend([self._decoded(ids, sizes) for _, ids, sizes in parts])
        self.known.update((w, i) for i, w in enumerate((w for own, _, _ in parts for _, w in own), first))

    def encode(self, pieces: list[list[str]]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text, given as its list of words."""
        distinct: set[str] = set()
        for p in pieces:
            distinct.update(p)
        if len(self.known) + len(distinct) > KEPT_WORDS:
            self.forget()
        self.learn(distinct)
        for p in pieces:
            at = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            yield self.ids.at(at), self.bytes.at(at).tobytes()


def encoded_texts(encoder: WordEncoder, split, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Ids and decoded bytes of each text; split is a compiled pattern. A text of more than BATCH_CHARS goes in slices of words."""
    short = iter(encoder.encode([split.findall(t) for t in texts if len(t) <= BATCH_CHARS]))
    for t in texts:
        if len(t) <= BATCH_CHARS:
            yield next(short)
            continue
        found, parts = (m[0] for m in split.finditer(t)), []
        while words := list(islice(found, SLICE_WORDS)):
            parts += encoder.encode([words])
        yield np.concatenate([p[0] for p in parts]), b"".join(p[1] for p in parts)


@lru_cache(maxsize=1)
def _encoder_at(path: str) -> WordEncoder:
    return WordEncoder(load_ranks(path))


def encoder_at(path: str) -> WordEncoder:
    """One for each worker process, so that its tasks share the words that are known, until another operator needs the room."""
    KEPT["bpe"] = _encoder_at.cache_clear
    return _encoder_at(path)


def batches(rows: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, by about as many characters at once; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for batch in rows:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py()
            if ids and size + len(text) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i), texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids binary of little-endian uint32, decoded binary) for each row of docs.

    ranks_path is a file of base64 tokens and ranks that every executor can read; pattern splits a text into words.
    """
    schema = f"{id_col} long, token_ids binary, decoded binary"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, encoder = regex.compile(pattern), encoder_at(ranks_path)
        for ids, texts in batches(rows):
            tokens, back = [], []
            for x, d in encoded_texts(encoder, split, texts):
                tokens.append(x.astype("<u4").tobytes()), back.append(d)
            yield pa.RecordBatch.from_pydict({id_col: pa.array(ids, pa.int64()), "token_ids": pa.array(tokens, pa.binary()), "decoded": pa.array(back, pa.binary())})

    return text_rows(docs, id_col, text_col).mapInArrow(frugal(run, "bpe"), schema)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents(), reduced where the ids are made: (id, n_tokens, ids_sha256, decoded_sha256)."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, encoder = regex.compile(pattern), encoder_at(ranks_path)
        for ids, texts in batches(rows):
            n, a, b = [], [], []
            for x, d in encoded_texts(encoder, split, texts):
                n.append(len(x)), a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()), b.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_pydict({id_col: pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})

    return text_rows(docs, id_col, text_col).mapInArrow(frugal(digest, "bpe"), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
