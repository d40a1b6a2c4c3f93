"""Quality classifier: document evidence combined with host and path posteriors, by hierarchical empirical Bayes.

Two small logistic models are fitted on a sample of SAMPLE_ROWS labelled documents at most, of any length (only their features and
the words' counts come to the driver): one for quality (shares of byte classes, lengths
and repetition of words and lines), one for toxicity (words that the sample's toxic documents have far more often). Over all
documents they give log likelihood ratios. Sums of the documents' probabilities by host and by path (map-side sums, so a hot host
is one row a task) are shrunk: a path toward its host, a host toward the global rate, each by a strength estimated from how much
the rates vary beyond chance. A document's posterior is its own evidence on top of its path's rate.

Defined results: a null or empty text has no evidence (ratio 0) and so its path's rate; a null host or path is a group of its own;
repeated rows count as often as they occur and get equal results; without labels of both classes a model gives no evidence and
its global rate is 1 for quality and 0 for toxicity; of labels that repeat an id the lowest quality and the highest toxicity
count; columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import few_rows, frugal, spool, table

#: The training sample: so many labelled documents at most, the first by a hash of the id.
SAMPLE_ROWS = 6000
#: Words that speak for toxicity: so many at most, in so many of the sample's toxic documents at least, surely (lower bound at
#: so many standard errors) so many times as often as in others.
WORDS, LEAST_DOCS, LEAST_ODDS, ERRORS = 2000, 3, 6.0, 1.64

_STRIP = {c: " " for c in range(0x21, 0x7F) if not chr(c).isalnum()}
_PUNCT = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]


def style(text: str) -> list[float]:
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    words, lines = text.split(), text.split("\n")
    letters = max(1, int(raw[0x41:0x5B].sum() + raw[0x61:0x7B].sum() + raw[0x80:].sum()))
    return [
        *(math.log1p(200.0 * raw[c] / n) for c in _PUNCT),
        math.log1p(20.0 * raw[0x41:0x5B].sum() / letters),
        math.log1p(50.0 * raw[0x30:0x3A].sum() / n),
        math.log1p(20.0 * raw[0x0A] / n),
        math.log1p(len(words)),
        len("".join(words)) / max(1, len(words)) / 8.0,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
    ]


def words_of(text: str) -> list[str]:
    return text.lower().translate(_STRIP).split()


def toxicity(text: str, weights: dict[str, float]) -> list[float]:
    words = words_of(text)
    hits = [w for w in words if w in weights]
    return [math.log1p(len(hits)), sum(weights[w] for w in set(hits)) / 4.0, math.log1p(1000.0 * len(hits) / max(1, len(words)))]


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features; ratio() is the log odds less those of the sample."""

    def __init__(self, x: list[list[float]], y: list[int], ridge: float = 1.0):
        self.fitted = 0 < sum(y) < len(y)
        if not self.fitted:
            return
        a, t = np.array(x), np.array(y, float)
        self.mean, self.scale = a.mean(0), a.std(0)
        self.scale[self.scale < 1e-9] = 1e9
        z = np.hstack([np.ones((len(a), 1)), (a - self.mean) / self.scale])
        w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (t - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.prior = w, math.log(t.mean() / (1 - t.mean()))

    def ratios(self, x: list[list[float]]) -> np.ndarray:
        if not self.fitted or not x:
            return np.zeros(len(x))
        z = (np.array(x) - self.mean) / self.scale
        return np.clip(z @ self.w[1:] + self.w[0] - self.prior, -25, 25)


@dataclass
class Model:
    style: Logistic
    weights: dict[str, float]
    toxic: Logistic
    rates: dict[str, float]


def _described(sample: DataFrame, label: str, describe) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the sample, in an order that doesn't depend on its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([describe(t.as_py()) for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sorted((r.x, r.y) for r in sample.select("text", F.col(label).cast("int")).mapInArrow(run, "x array<double>, y int").collect())
    return [x for x, _ in got], [y for _, y in got]


def _telling_words(sample: DataFrame, n: int, m: int) -> dict[str, float]:
    """Weights of words that toxic documents have surely more often: the lower bound of their log odds. n, m: documents that aren't
    toxic, that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = sorted(set(words_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], names=["word", "toxic"])

    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.count("*").alias("docs"), F.sum("toxic").alias("k")).where(F.col("k") >= LEAST_DOCS)
    other = F.col("docs") - F.col("k") + 0.5
    sure = F.log((F.col("k") / m) / (other / n)) - ERRORS * F.sqrt(1 / F.col("k") + 1 / other)
    kept = counts.select("word", F.round(sure, 12).alias("sure")).where(F.col("sure") >= math.log(LEAST_ODDS)).orderBy(F.desc("sure"), "word").limit(WORDS)
    return {r.word: r.sure for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The sample is a written table of `rows` rows; features (a few dozen numbers a row) and WORDS words come to the driver."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null and toxic is not null")
    order = F.xxhash64("doc_id", F.lit(11))
    known = own.orderBy(order, "doc_id").limit(3 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spool(known.join(texts.where("text <> ''").select("doc_id", F.xxhash64("text").alias("hash")), "doc_id").orderBy(order, "doc_id", "hash").limit(rows).distinct(), "labelled")  # ids first: texts aren't sorted
    sample = spool(texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(held), ["doc_id", "hash"]).select("doc_id", "text", "quality", "toxic").dropDuplicates(["doc_id", "text"]), "sample")
    style_of = Logistic(*_described(sample, "quality", style))
    labelled = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    weights = _telling_words(sample, max(1, labelled.n - labelled.bad), max(1, labelled.bad))
    toxic = Logistic(*_described(sample, "toxic", lambda t: toxicity(t, weights)))
    return Model(style_of, weights, toxic, {"quality": labelled.good / labelled.n if style_of.fitted else 1.0, "toxic": labelled.bad / labelled.n if toxic.fitted else 0.0})


def evidence(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, host, path, quality_ratio, toxic_ratio) for every row; doc_id is what id_col holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(3).to_pylist()
                empty = np.array([not t for t in texts])
                q = np.where(empty, 0.0, model.style.ratios([style(t) for t in texts]))
                x = np.where(empty, 0.0, model.toxic.ratios([toxicity(t, model.weights) for t in texts]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(q), pa.array(x)], names=["doc_id", "host", "path", "quality_ratio", "toxic_ratio"])

    return rows.mapInArrow(frugal(run), "doc_id long, host string, path string, quality_ratio double, toxic_ratio double")


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, n: str, total: str, toward: Column) -> Column:
    """Pseudo-documents of a beta prior by the method of moments: m(1-m)/var - 1, between 1 and 1000."""
    rate = F.col(total) / F.col(n)
    chance = toward * (F.lit(1.0) - toward) / F.col(n)
    extra = F.sum(F.col(n) * ((rate - toward) * (rate - toward) - chance)) / F.sum(n)
    spread = F.sum(F.col(n) * toward * (F.lit(1.0) - toward)) / F.sum(n)
    return F.coalesce(F.least(F.greatest(spread / F.greatest(extra, F.lit(1e-9)) - F.lit(1.0), F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0))


def posteriors(found: DataFrame, rates: dict[str, float]) -> DataFrame:
    """evidence() with p_quality, p_toxic and the rates of host and path that they rest on."""
    prob = {k: _sigmoid(F.col(f"{k}_ratio") + _logit(F.lit(rates[k]))) for k in rates}
    paths = spool(found.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *(F.sum(p).alias(k) for k, p in prob.items())), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in rates))
    overall = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), *(F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in rates)).first()
    base = {k: overall[k] / overall["n"] if overall["n"] else rates[k] for k in rates}
    s = hosts.agg(*(_strength(hosts, "n", k, F.lit(base[k])).alias(k) for k in rates)).first()
    shrunk = hosts.select("host", *(((F.col(k) + F.lit(s[k] * base[k])) / (F.col("n") + F.lit(s[k]))).alias(f"host_{k}") for k in rates)).withColumnRenamed("host", "h")
    placed = spool(paths.join(shrunk, paths.host.eqNullSafe(shrunk.h)).drop("h"), "placed")
    t = placed.agg(*(_strength(placed, "n", k, F.col(f"host_{k}")).alias(k) for k in rates)).first()
    sites = placed.select(F.col("host").alias("h"), F.col("path").alias("p"), *(f"host_{k}" for k in rates), *(((F.col(k) + F.lit(t[k]) * F.col(f"host_{k}")) / (F.col("n") + F.lit(t[k]))).alias(f"path_{k}") for k in rates))
    sites = few_rows(sites)
    out = found.join(sites, found.host.eqNullSafe(sites.h) & found.path.eqNullSafe(sites.p)).drop("h", "p")
    return out.withColumns({f"p_{k}": _sigmoid(F.col(f"{k}_ratio") + _logit(F.col(f"path_{k}"))) for k in rates})


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, least_quality: float = 0.5, most_toxic: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, host, path, ratios, rates, p_quality, p_toxic, keep) for every row of docs; rejected: low quality or toxic.

    Labels go by docs.doc_id; id_col names the column that tells rows apart in the result."""
    model = fit(docs, labels)
    out = posteriors(spool(evidence(docs, model, host, path, id_col), "evidence"), model.rates)
    return out.withColumn("keep", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: host is the source, path the source's part in one language."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.round("path_quality", 6).alias("path_quality"), F.round("host_quality", 6).alias("host_quality"), "keep")
