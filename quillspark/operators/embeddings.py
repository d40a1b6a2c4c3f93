"""Embedding links between records: texts are embedded in batches where they are, unit vectors are searched for near pairs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.functions.checkpoints import written
from quillspark.operators.vectors import COSINE, NEIGHBOURS, nearest, similar_pairs

log = logging.getLogger(__name__)

#: Texts that the encoder gets at once, and settings that turn the layer on.
BATCH, ON = 16, ("1", "true", "yes")

#: (texts) -> a matrix with a row for each. It is sent to the executors.
Encoder = Callable[[list[str]], np.ndarray]


def embed(records: DataFrame, encode: Encoder, batch: int = BATCH) -> DataFrame:
    """(idx, embedding array<float>) of records (idx, title, abstract): unit vectors; an answer that isn't a matrix of a row for each text
    fails."""
    rows = records.select("idx", t.embedding_text(F.col("title"), F.col("abstract")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                x = np.asarray(encode(b.column(1).to_pylist()), np.float32)
                if x.ndim != 2 or len(x) != b.num_rows:
                    raise ValueError(f"the encoder must give a matrix of {b.num_rows} rows, not of shape {x.shape}")
                size = np.linalg.norm(x, axis=1, keepdims=True)
                unit = (x / np.where(size == 0, 1, size)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(unit), pa.list_(pa.float32()))], names=["idx", "embedding"])

    return rows.mapInArrow(run, "idx long, embedding array<float>")


def embedding_pairs(records: DataFrame, encode: Encoder, threshold: float = COSINE, k: int = NEIGHBOURS) -> DataFrame:
    """(i, j, similarity), i < j, of records that are among each other's k nearest and similar enough."""
    vectors = written(embed(records, encode), "embedded")
    near = nearest(vectors, F.lit(True), k, "idx", "embedding")
    pairs = near.where((F.col("i") != F.col("j")) & (F.col("similarity") >= threshold))
    return pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("similarity").alias("similarity"))


def layer_wanted(asked: bool | None, env: Mapping[str, str], name: str) -> bool:
    """asked, or where it is None what the setting `name` says."""
    return asked if asked is not None else env.get(name, "0").lower() in ON


def optional_pairs(records: DataFrame, encode: Encoder | None, wanted: bool, threshold: float = COSINE) -> DataFrame | None:
    """embedding_pairs() as a written table; None where the layer is off, has nothing to compare or fails, which is logged: the report
    then rests on the other links."""
    if not wanted or records.limit(2).count() < 2:
        return None
    try:
        if encode is None:
            raise ValueError("no encoder is given")
        return written(embedding_pairs(records, encode, threshold), "embedding-pairs")
    except Exception as error:  # noqa: BLE001 whatever an encoder raises must not cost the report
        log.warning("embedding layer skipped: %s", error)
        return None
