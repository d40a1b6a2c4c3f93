"""Which records hold which of many spans: one automaton over the spans reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import collapse

#: Characters of spans in one automaton; more spans take more automata, each over all records.
BLOCK_CHARS = 4_000_000


def holders(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", span_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id) of each record's text that holds a span's text, white space collapsed in both; blank spans are in nothing."""
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.coalesce(collapse(F.col("text")), F.lit("")).alias("text"))
    asked = spans.select(F.col(span_id).cast("long").alias(span_id), collapse(F.col("text")).alias("text")).where("text <> ''")
    blocks = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // BLOCK_CHARS + 1
    out = None
    for turn in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == turn).collect()
        found = rows.mapInArrow(_search([(r[span_id], r.text) for r in own], doc_id, span_id), f"{doc_id} long, {span_id} long")
        out = found if out is None else out.union(found)
    return out


def _search(spans: list[tuple[int, str]], doc_id: str, span_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for i, s in spans:
            ids.setdefault(s, []).append(i)
        tree = ahocorasick.Automaton()
        for s, own in ids.items():
            tree.add_word(s, own)
        tree.make_automaton()
        for b in batches:
            pairs: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = {i for _, own in tree.iter(text.as_py()) for i in own} if ids else set()
                pairs += [(doc, i) for i in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=[doc_id, span_id])

    return run
