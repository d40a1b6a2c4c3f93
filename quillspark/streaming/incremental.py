"""Record routing as a stream: rows are routed as files arrive and appended, so a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.insights import route


def route_stream(records: DataFrame) -> DataFrame:
    """(idx, pmid, action, reason, input_hash) of a stream of records; no state is kept."""
    return route(records).select("idx", "pmid", "action", "reason", "input_hash")


def append_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet files at path: each input file counts once, after failures too. What is there is read, then the query ends."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed_from_files(spark: SparkSession, source: str, schema: str, to_records, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over the Parquet files at source to its end and reads what it appended."""
    query = append_results(route_stream(to_records(spark.readStream.schema(schema).parquet(source))), path, checkpoint)
    query.awaitTermination()
    return spark.read.schema("idx long, pmid string, action string, reason string, input_hash string").parquet(path)
