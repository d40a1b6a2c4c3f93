"""Joins, caches and reports over records and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that a report lists for each status, and a preview of missing ids names.
LISTED, PREVIEW = 100, 20
STATUSES = ("auto_accepted", "validated_but_flagged", "needs_human_review", "invalid_output", "api_failure", "skipped_prefilter")


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row")).select(key, "_row.*")


def in_request_order(requested: DataFrame, found: DataFrame, key: str = "pmid", place: str = "pos", order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(found rows in the order of requested (key, place), the last of each key; requested rows that weren't found)."""
    rows = last_of(found, key, order)
    return requested.join(rows, key).orderBy(place), requested.join(rows.select(key), key, "left_anti").orderBy(place)


def missing_preview(missing: DataFrame, key: str = "pmid", place: str = "pos", most: int = PREVIEW) -> DataFrame:
    """One row: how many are missing, the first `most` of them and how many more there are."""
    first = missing.orderBy(place).limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, key))), lambda x: x[key]), ", ").alias("named"))
    n = missing.agg(F.count("*").alias("n_missing"))  # both sides have one row
    more = F.when(F.col("n_missing") > most, F.concat(F.col("named"), F.lit(" (+"), (F.col("n_missing") - most).cast("string"), F.lit(" more)"))).otherwise(F.col("named"))
    return n.join(first).select("n_missing", more.alias("preview"))


def with_cache(rows: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    """rows with cached (null where the cache has nothing for their key)."""
    return rows.join(cache.select(key, F.col("v").alias("cached")), key, "left")


def upsert(cache: DataFrame, new: DataFrame, key: str = "k") -> DataFrame:
    """cache (k, v) with the rows of new (k, v, pos): of a key's new rows the last counts."""
    fresh = new.groupBy(key).agg(F.max_by("v", "pos").alias("v"))
    return cache.join(fresh.select(key), key, "left_anti").select(key, "v").union(fresh.select(key, "v"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def finding_counts(results: DataFrame, label: Column) -> DataFrame:
    """Counts of a label as it was given, where there is one."""
    return results.where(label.isNotNull()).groupBy(label.alias("finding_direction")).agg(F.count("*").alias("n"))


def review_lists(results: DataFrame, statuses: tuple[str, ...] = ("needs_human_review", "invalid_output", "api_failure"), most: int = LISTED) -> DataFrame:
    """(status, pmids): the first `most` ids of each status in row order, "(none)" if there are none."""
    spark = results.sparkSession
    first = Window.partitionBy("status").orderBy("idx")
    held = results.where(F.col("status").isin(*statuses)).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    named = held.groupBy("status").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "pmid"))), lambda x: x["pmid"]), ", ").alias("pmids"))
    return spark.createDataFrame([(s,) for s in statuses], "status string").join(named, "status", "left").select("status", F.coalesce("pmids", F.lit("(none)")).alias("pmids"))


def job_totals(results: DataFrame) -> DataFrame:
    """One row of counters; results has status, skipped, minimal, truncated and token counts."""
    names = {"auto_accepted": "auto_accepted", "validated_but_flagged": "validated_but_flagged", "needs_review": "needs_human_review", "invalid_output": "invalid_output", "api_failures": "api_failure", "skipped_prefilter": "skipped_prefilter"}
    return results.agg(
        *(F.count_if(F.col("status") == s).alias(n) for n, s in names.items()),
        F.count_if("truncated").alias("truncation_warning"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def gold_and_predicted(gold: DataFrame, predicted: DataFrame, key: str = "pmid", order: str = "pos") -> DataFrame:
    """(key, gold, predicted) of the keys that both have, the last row of each."""
    g, p = last_of(gold.withColumn(key, F.col(key).cast("string")), key, order), last_of(predicted.withColumn(key, F.col(key).cast("string")), key, order)
    return g.select(key, F.col("label").alias("gold")).join(p.select(key, F.col("label").alias("predicted")), key)


def row_counts(gold: DataFrame, predicted: DataFrame, key: str = "pmid") -> DataFrame:
    """One row: distinct keys of gold and of predicted, and those that both have."""
    sides = gold.select(F.col(key).cast("string").alias("k"), F.lit(1).alias("g"), F.lit(0).alias("p")).union(predicted.select(F.col(key).cast("string"), F.lit(0), F.lit(1)))
    each = sides.groupBy("k").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return each.agg(F.count_if(F.col("g") == 1).alias("n_gold"), F.count_if(F.col("p") == 1).alias("n_predicted"), F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("n_common"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every label and "accuracy", "macro avg" and "weighted avg"; 0 where nothing divides."""
    hits = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))  # at most labels squared
    each = hits.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")))).alias("e"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("both"))
    each = each.groupBy("e.label").agg(F.sum("e.support").alias("support"), F.sum("e.guessed").alias("guessed"), (F.sum("both") / 2).alias("hit"))
    precision, recall = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    by = each.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = by.agg(*((F.sum("hit") / total).alias(s) for s in scores), total.alias("support"))
    macro = by.agg(*(F.avg(s).alias(s) for s in scores), total.alias("support"))
    weighted = by.agg(*((F.sum(F.col(s) * F.col("support")) / total).alias(s) for s in scores), total.alias("support"))
    parts = [by.select("label", *scores, "support"), *(d.select(F.lit(n).alias("label"), *scores, "support") for n, d in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
