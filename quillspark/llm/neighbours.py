"""Approximate nearest neighbours by an adaptive scan of dimensions.

An index is fitted on a bounded sample: centroids of lists, a random rotation, and how many lists a query must probe so that its
neighbours in the sample lie there (a share RECALL of them). Every vector goes to its nearest list; a list is cut into parts of
bounded size, so copies of one vector spread over many. In each probed part vectors are rotated and laid out in blocks of columns.
A query's partial distance over the first columns, scaled to all, is tested against the distance of its K-th best so far: where the
hypothesis that the vector is nearer is rejected, it is abandoned; what survives all blocks is measured exactly, in double
precision, on the original vectors. A query whose lists hold fewer than K others probes on until they do. Vectors are scanned by batches in the order of their first columns, so that the bound tightens
from batch to batch. The best of all parts are merged.

A part's queries come to it. Only the vectors of a list that more than QUERIES probe are copied, once for each block of its queries;
vectors of lists that none probes don't move. So a task holds at most about PART * QUERIES pairs. Lists grow with the square root of
the vectors, up to a share of the sample; beyond that they are cut into more parts.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part, neither do null ids; vectors of
different dimension aren't compared; a query isn't its own neighbour; of equal distances the smaller id is nearer; rows that repeat
a query's id ask once, with the smallest vector; repeated rows of other ids are found as often as they occur; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.base import spool, table

#: Vectors in the sample, vectors of the sample for each list at least, and the share of neighbours in the sample that probed lists
#: must hold.
SAMPLE, PER_LIST, RECALL = 8192, 4, 0.97
#: Vectors and queries that meet in one task, vectors in one batch of a scan, columns in the first block, and the strictness of the
#: test (in standard errors).
PART, QUERIES, BATCH, COLUMNS, STRICT = 2048, 4096, 512, 16, 2.6


def valid(v: str) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Index:
    """Rotation, centroids and number of probed lists, from a sample of `rows` vectors of altogether `total`."""

    def __init__(self, sample: np.ndarray, total: int, k: int, recall: float = RECALL, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        n = int(max(1, min(round(total**0.5), len(sample) // PER_LIST)))
        x = sample.astype(np.float32)
        self.centroids = x[np.sort(rng.choice(len(x), n, replace=False))].copy()
        for _ in range(8):
            own = self.order(x, 1)[:, 0]
            for c in range(n):
                if (m := own == c).any():
                    self.centroids[c] = x[m].mean(0)
        own = self.order(x, 1)[:, 0]
        asked = np.sort(rng.choice(len(x), min(len(x), 256), replace=False))
        ranks = []
        for q in asked:
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            place = np.empty(n, int)
            place[self.order(x[q : q + 1], n)[0]] = np.arange(n)
            ranks += place[own[near]].tolist()
        self.probes = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else n

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        d = (self.centroids**2).sum(1)[None, :] - 2 * x.astype(np.float32) @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def scan_part(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, ids, distances) of the k nearest of x to each of q, which may be missed with the probability of the tests."""
    dim = x.shape[1]
    edges = [0, *(e for e in (COLUMNS, 2 * COLUMNS) if e < dim), dim]
    xr, qr = x.astype(np.float32) @ rotation, q.astype(np.float32) @ rotation
    blocks = [np.ascontiguousarray(xr[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    slack = 1e-5 * ((qr**2).sum(1) + float((xr**2).sum(1).max(initial=0)))  # what single precision may lose in sums and differences
    first = np.maximum(0, (blocks[0] ** 2).sum(1)[None, :] + (qr[:, : edges[1]] ** 2).sum(1)[:, None] - 2 * qr[:, : edges[1]] @ blocks[0].T)
    for i in range(len(q)):
        alive = np.flatnonzero(ids != asks[i])
        if not len(alive):
            continue
        if len(alive) > k:
            order = alive[np.argsort(first[i, alive], kind="stable")]
            likely = order[:k]
            best = np.sort(((xr[likely] - qr[i]) ** 2).sum(1))  # squared distances of the k best so far
            found = [likely]
            for at in range(k, len(order), BATCH):
                batch = order[at : at + BATCH]
                partial, bound = first[i, batch], float(best[-1]) + float(slack[i])
                for b in range(1, len(edges)):
                    done = edges[b]
                    limit = bound if done == dim else bound * done / dim * (1 + STRICT / done**0.5) ** 2 + float(slack[i])
                    keep = partial <= limit
                    batch, partial = batch[keep], partial[keep]
                    if done == dim or not len(batch):
                        break
                    partial = partial + ((blocks[b][batch] - qr[i, done : edges[b + 1]]) ** 2).sum(1)
                if len(batch):
                    found.append(batch)
                    best = np.sort(np.concatenate([best, partial]))[:k]
            alive = np.concatenate(found)
            if len(alive) > 4 * k:
                whole = ((xr[alive] - qr[i]) ** 2).sum(1)
                alive = alive[whole <= np.partition(whole, k - 1)[k - 1] + 2 * slack[i]]
        exact = np.sqrt(((x[alive] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[alive], exact))[:k]
        yield i, ids[alive][best], exact[best]


def _placed(rows: DataFrame, index: Index, probes: int, held: np.ndarray | None = None) -> DataFrame:
    """(id, v binary of doubles, list): each vector with its nearest `probes` lists; with as many more as hold `least` vectors, a third
    column, where held has the number of vectors in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    lists = index.order(x, probes if held is None else len(index.centroids))
                    taken = np.full(len(x), lists.shape[1])
                    if held is not None:
                        short = (np.cumsum(held[lists], axis=1) < part.column(2).to_numpy()[:, None]).sum(1)
                        taken = np.minimum(np.maximum(probes, short + 1), taken)
                    raw = [v for v, n in zip(map(np.ndarray.tobytes, x), taken.tolist(), strict=True) for _ in range(n)]
                    lists = lists[np.arange(lists.shape[1])[None, :] < taken[:, None]]
                    yield pa.RecordBatch.from_pydict({"id": np.repeat(np.array(part.column(0)), taken), "v": pa.array(raw, pa.binary()), "list": lists.astype(np.int32)})

    return rows.mapInArrow(run, "id long, v binary, list int")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors found for each row that is_query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & valid("v"))
    out = None
    for dim, total in sorted((r["dim"], r["count"]) for r in rows.groupBy(F.size("v").alias("dim")).count().collect()):
        found = _search_dim(rows.where(F.size("v") == dim), total, k)
        out = found if out is None else out.union(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _search_dim(rows: DataFrame, total: int, k: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()
    index = Index(np.array([r.v for r in sample]), total, k)
    vectors = spool(_placed(rows.select("id", "v"), index, 1), "vectors")
    sizes = spool(vectors.groupBy("list").agg(F.count("*").alias("n")), "sizes")  # a row for each list: at most SAMPLE / PER_LIST
    held = np.zeros(len(index.centroids), np.int64)
    for r in sizes.collect():
        held[r["list"]] = r["n"]
    asking = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"), (F.count("*") + k).alias("least"))  # its own rows don't count
    probing = spool(_placed(asking, index, index.probes, held), "probing")
    parts = spool(sizes.join(probing.groupBy("list").agg(F.count("*").alias("asked")), "list", "left").select("list", F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.coalesce("asked", F.lit(0)) / QUERIES).alias("blocks")), "parts")
    # A list that more than QUERIES ask has as many blocks of queries; only its own vectors are copied to them.
    asked = probing.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    held = vectors.join(F.broadcast(parts.where("blocks > 0")), "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rotation, names = index.rotation, ["list", "part", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if left.num_rows and right.num_rows:
            read = lambda t: (t["id"].to_numpy(), np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, -1))
            (ids, x), (asks, q) = read(left), read(right)
            for i, found, score in scan_part(ids, x, asks, q, rotation, k):
                cols["query_id"].append(np.full(len(found), asks[i])), cols["vec_id"].append(found), cols["score"].append(score)
        return pa.table({c: np.concatenate(v) for c, v in cols.items()})

    return held.select(*names, "id", "v").groupBy(*names).cogroup(asked.select(*names, "id", "v").groupBy(*names)).applyInArrow(run, "query_id long, vec_id long, score double")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
