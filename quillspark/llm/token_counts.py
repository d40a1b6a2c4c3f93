"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds some pre-tokens with their token counts, an inner node the sums of characters and tokens below. An edit goes down to
the leaves that it touches; splitting starts again one pre-token before it (a pre-token depends on no more than the character after
it) and ends where a new border meets an old one behind the edit: from there on the pre-tokens are the old ones. Only what lies
between is encoded anew, and only the sums above those leaves change.

Defined results: a null or empty text has 0 tokens and can be edited; a null list of edits is empty; an edit's place and length are
clipped to the text; null parts of an edit are 0 or empty; a null id is kept; repeated rows are counted each; texts of any length
are counted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import table
from quillspark.llm.packing import tokenizer

#: Pre-tokens in a new leaf; a leaf of four times as many makes the tree be built again. Counts of pre-tokens that are remembered.
LEAF, KEPT = 64, 500_000


class CountTree:
    """The pre-tokens of a text in a segment tree; split gives a text's pre-tokens, count a pre-token's tokens."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.split, self.count, self.encoded = split, count, 0
        pieces = split(text)
        self.encoded += len(pieces)
        self.build(pieces, [count(p) for p in pieces])

    def build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (p, c) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, p)), sum(c)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf, _ in self.leaves for p in leaf)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last, behind the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (pieces, counts)
        i = leaf + self.width
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        i >>= 1
        while i:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            i >>= 1

    def edit(self, at: int, removed: int, inserted: str) -> None:
        at = min(max(0, at), self.n_chars)
        stop = min(at + max(0, removed), self.n_chars)
        if at == stop and not inserted:
            return
        first, start = self._leaf(max(0, at - 2))
        last, _ = self._leaf(stop)
        while True:
            pieces = [p for leaf in self.leaves[first : last + 1] for p in leaf[0]]
            counts = [c for leaf in self.leaves[first : last + 1] for c in leaf[1]]
            k, place = 0, start
            while k < len(pieces) - 1 and place + len(pieces[k]) < at - 1:
                place += len(pieces[k])
                k += 1
            old = "".join(pieces[k:])
            ahead = self._ahead(last)
            new = old[: at - place] + inserted + old[stop - place :]
            shift = len(inserted) - (stop - at)
            borders, x = {}, place
            for j in range(k, len(pieces)):
                if x >= stop:
                    borders[x + shift] = j
                x += len(pieces[j])
            if not ahead:
                borders[x + shift] = len(pieces)
            fresh, x, meets = [], place, None
            for p in self.split(new + ahead):
                if x in borders and x >= at + len(inserted):
                    meets = borders[x]
                    break
                fresh.append(p)
                x += len(p)
            if meets is None and not ahead:
                meets = len(pieces)
            if meets is not None:
                break
            last += 1  # no border met yet: further to the right
        self.encoded += len(fresh)
        kept, n = pieces[:k] + fresh + pieces[meets:], counts[:k] + [self.count(p) for p in fresh] + counts[meets:]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [], [])
        self._set(first, kept, n)
        if len(kept) > 4 * LEAF:
            self.build([p for leaf, _ in self.leaves for p in leaf], [c for _, leaf in self.leaves for c in leaf])

    def _ahead(self, leaf: int) -> str:
        """The text's next pre-token behind a leaf."""
        for pieces, _ in self.leaves[leaf + 1 :]:
            if pieces:
                return pieces[0]
        return ""


def count_edited(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_before, n_after, n_chars, n_pretokens, n_reencoded) for each row of docs; edits: array<struct<at int, removed int,
    inserted string>>, applied one after another, each to the text that the last one left; places count code points."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), edits.alias("edits"))
    names = [id_col, "n_before", "n_after", "n_chars", "n_pretokens", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, enc = regex.compile(pattern).findall, tokenizer(ranks_path, pattern)
        known: dict[str, int] = {}

        def count(piece: str) -> int:
            n = known.get(piece)
            if n is None:
                if len(known) >= KEPT:
                    known.clear()
                n = known[piece] = len(enc.encode_ordinary(piece))
            return n

        for batch in batches:
            out: list[tuple] = []
            for doc, text, changes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(text.as_py(), split, count)
                before, tree.encoded = tree.n_tokens, 0
                for e in changes or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((doc, before, tree.n_tokens, tree.n_chars, sum(len(p) for p, _ in tree.leaves), tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sample_edits(text: Column, key: Column) -> Column:
    """Four edits of each text, from hashes of its id: a deletion, an insertion, a replacement by words of the text, one at the end."""
    size = F.greatest(F.length(text), F.lit(1))

    def place(k: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(k)), size).cast("int")

    def edit(at: Column, removed: int, inserted: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    return F.array(
        edit(place(1), 17, F.lit("")),
        edit(place(2), 0, F.lit(" an added clause, 2024's first")),
        edit(place(3), 9, F.substring(text, 1, 40)),
        edit(F.length(text), 0, F.lit("\n\nThe end.")),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    return count_edited(docs, sample_edits(text, F.col("doc_id")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
