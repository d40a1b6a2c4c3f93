"""Token-id matrices: documents are encoded, split where they are too long, and packed best fit decreasing.

Each task packs its documents by some million tokens at a time, so nothing is shuffled and memory is bounded; every group ends with
at most a few rows that aren't full. Pieces are placed longest first into the open row with the least room that suffices; a segment
tree over room sizes finds it. No token is dropped: a document longer than a row becomes full rows and a rest.

Defined results: a null or empty text has no tokens and so no segment; a null id is kept; repeated rows are packed as often as they
occur; texts of any length are encoded whole; of rows with equal room the one opened last is taken; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.base import table, text_rows

#: Tokens in a row, and tokens that are packed together.
ROW, GROUP = 2048, 2_000_000


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """A segment tree over room sizes 0..most, with how many open rows have each."""

    def __init__(self, most: int):
        self.leaves = 1 << (most).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of `need` or more that some row has."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """Indexes of the pieces in each row; every size is between 1 and most."""
    rows: list[list[int]] = []
    open_rows: dict[int, list[int]] = {}
    tree = RoomTree(most)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, most
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left)
    return rows


SCHEMA = "pack string, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_starts array<long>"
_ARROW = pa.schema([("pack", pa.string()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


def pack_group(docs: list[tuple[int | None, np.ndarray]], most: int, name: str, pad: int, width: str) -> Iterator[tuple]:
    pieces = [(doc, at, ids[at : at + most]) for doc, ids in docs for at in range(0, len(ids), most)]
    for k, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], most)):
        out = np.full(most, pad, width)
        ends = [0]
        for i in row:
            out[ends[-1] : ends[-1] + len(pieces[i][2])] = pieces[i][2]
            ends.append(ends[-1] + len(pieces[i][2]))
        yield f"{name}-{k}", ends[-1], out.tobytes(), ends, ends[:-1], [pieces[i][0] for i in row], [pieces[i][1] for i in row]


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, most: int = ROW, pad: int = 50_256, width: str = "<u2", group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One line for each row of the id matrix: ids (most numbers of type width, padded), cumulative segment lengths, the places where
    positions start again at 0, and for each segment its document and the place in it of the segment's first token.

    The name of a row tells the partition, the group in it and the row in that. pad must not be a token and must fit into width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, groups, held, size = tokenizer(ranks_path, pattern), TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            rows = list(pack_group(held, most, f"{part}-{groups}", pad, width))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(enc.encode_ordinary(text.as_py()), width)
                held.append((doc, ids))
                size += len(ids)
                if size >= group:
                    yield out()
                    groups, held, size = groups + 1, [], 0
        yield out()

    return text_rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def positions(cu_seqlens: list[int], most: int = ROW) -> np.ndarray:
    """A row's position numbers: from 0 in each segment, 0 in what is padded."""
    out = np.zeros(most, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
