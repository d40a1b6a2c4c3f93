"""Search, fetch and parse as one plan: result pages and batches of ids are dealt to at most MOST_TASKS tasks that read where they run."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.checkpoints import written
from quillspark.operators.records import in_request_order, missing_preview
from quillspark.sources.article_xml import in_band_error, parse_documents
from quillspark.sources.paged import BATCH, PAGE, SourceError, batches, rate, search_page

log = logging.getLogger(__name__)

#: Parameters that every request has, or has where they are known, and warnings that a collection lists.
DATABASE, OPTIONAL, MOST_WARNINGS = "pubmed", ("api_key", "email"), 20

#: Tasks of a search, and of its fetches: each reads many pages or batches, one after another, so that tasks don't grow with the input.
MOST_TASKS = 256

#: A page of the search: (first place, size) -> answer. A batch: (ids) -> answer. Both are sent to the executors.
Page = Callable[[int, int], str]
Fetch = Callable[[list[str]], str]


def settings(env: Mapping[str, str], path: str | Path = ".env") -> dict[str, str]:
    """env with the lines NAME=value of a file, if there is one, for names that env doesn't have."""
    out = {}
    if os.path.isfile(path):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and name and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return {**out, **env}


def request_params(tool: str, api_key: str | None = None, email: str | None = None, **own: object) -> dict[str, object]:
    """A request's parameters on top of the common ones."""
    given = dict(zip(OPTIONAL, (api_key, email), strict=True))
    return {"db": DATABASE, "tool": tool, **{k: v for k, v in given.items() if v}, **own}


def shared_rate(has_key: bool, readers: int) -> float:
    """Calls a second for each of so many processes that read at once: together they keep to the source's rate."""
    return rate(has_key) / max(1, readers)


def cap_notice(total: int, most: int) -> str | None:
    """What to say where a search matches more than was asked for."""
    return f"The search matches {total} records, more than the {most} asked for; only the first {most} are returned." if total > most else None


@dataclass
class PagePartition(InputPartition):
    """Pages from place `start` to before `stop`."""

    start: int
    stop: int


def search_source(name: str, page: Page) -> type[DataSource]:
    """A data source `name` of (start, asked, nth, pmid), a partition for each run of pages; a page without ids gives one row without
    pmid. Options: first (place of the first record), most (place behind the last), page (records a page)."""

    class Reader(DataSourceReader):
        def __init__(self, first: int, most: int, size: int):
            self.first, self.most, self.size = first, most, size

        def partitions(self) -> list[InputPartition]:
            pages = -(-max(0, self.most - self.first) // self.size)
            step = self.size * max(1, -(-pages // MOST_TASKS))
            return [PagePartition(i, min(i + step, self.most)) for i in range(self.first, self.most, step)] or [PagePartition(0, 0)]

        def read(self, partition: PagePartition) -> Iterator[tuple]:
            for start in range(partition.start, partition.stop, self.size):
                asked = min(self.size, partition.stop - start)
                ids = search_page(page(start, asked))[1]
                yield from ((start, asked, n, i) for n, i in enumerate(ids))
                if not ids:
                    yield start, asked, 0, None

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "start long, asked int, nth int, pmid string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(*(int(self.options.get(k, d)) for k, d in (("first", "0"), ("most", "0"), ("page", str(PAGE)))))

    return Search


def search(spark: SparkSession, name: str, page: Page, most: int, size: int = PAGE) -> tuple[int, DataFrame]:
    """(total, ids (pos, pmid)): the first page tells the total, the others are read in parallel. As in a scan one after another, what
    comes after the first page that is short or empty doesn't count."""
    if most < 1:
        raise ValueError("the number of records asked for must be 1 or more")
    asked = min(size, most)
    total, first = search_page(page(0, asked))
    spark.dataSource.register(search_source(name, page))
    stop = min(most, total)
    goes_on = len(first) == asked < stop
    rest = spark.read.format(name).option("first", asked if goes_on else 0).option("most", stop if goes_on else 0).option("page", size).load()
    pages = written(rest, "pages")
    short = pages.groupBy("start", "asked").agg(F.count("pmid").alias("n")).where("n < asked").agg(F.min("start").alias("at")).first()["at"]
    kept = pages.where(F.col("pmid").isNotNull() & ((F.col("start") <= short) if short is not None else F.lit(True)))
    own = spark.createDataFrame([(n, i) for n, i in enumerate(first[:most])], "pos long, pmid string")
    found = own.union(kept.select((F.col("start") + F.col("nth")).alias("pos"), "pmid"))
    notice = cap_notice(total, most)
    if notice:
        log.info(notice)
    return total, found.where(F.col("pos") < (stop if total else most))


def collect(spark: SparkSession, query: str, count: int, page: Page, fetch: Fetch, name: str = "record_search", size: int = PAGE) -> tuple[DataFrame, dict]:
    """(records with idx in the order of the search, header): search, fetch in batches, parse; a record that comes twice counts as the
    last. Warnings: records that can't be read, ids that didn't come; a notice, if more match than are asked for."""
    total, ids = search(spark, name, page, count, size)
    ids = written(ids, "ids")
    answers = fetched(ids, checked(fetch), min(MOST_TASKS, -(-count // BATCH)))
    parsed = written(parse_documents(answers), "parsed")
    rows = parsed.where("record is not null").select((F.col("pos") * 1_000_000 + F.col("nth")).alias("at"), "record.*")
    found, missing = in_request_order(ids, rows, order="at")
    records = written(found.drop("at").withColumnRenamed("pos", "idx"), "records")
    warnings = [r.warning for r in parsed.where("warning is not null").orderBy("pos", "nth").limit(MOST_WARNINGS - 1).collect()]
    gone = missing_preview(missing).first()
    if gone.n_missing:
        warnings.append(f"{gone.n_missing} records were not returned: {gone.preview}")
    return records, {"query": query, "total_match_count": total, "requested_count": count, "retrieved_count": records.count(), "warnings": warnings, "notice": cap_notice(total, count)}


def fetched(ids: DataFrame, fetch: Fetch, tasks: int) -> DataFrame:
    """(pos, ids, xml): the answers for ids (pos, pmid) in batches of BATCH, in order; each of so many tasks fetches many of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for pos, own in zip(pdf["pos"], pdf["own"], strict=True):
                for n, batch in enumerate(batches([r["pmid"] for r in own])):
                    yield pd.DataFrame({"pos": [pos * BATCH + n], "ids": [",".join(batch)], "xml": [fetch(batch)]})

    own = ids.withColumn("batch", F.floor(F.col("pos") / BATCH)).repartition(tasks, "batch").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "pmid"))).alias("own"))
    return own.select(F.col("batch").alias("pos"), "own").mapInPandas(run, "pos long, ids string, xml string")


def checked(fetch: Fetch) -> Fetch:
    """fetch, which fails where the answer says an error."""

    def run(ids: list[str]) -> str:
        text = fetch(ids)
        said = in_band_error(text)
        if said:
            raise SourceError(said)
        return text

    return run
