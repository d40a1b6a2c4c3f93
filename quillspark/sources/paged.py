"""A paged search with batched fetches, as a data source of Spark; the transport is injected, so tests need no network."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values.
PAGE, BATCH = 10_000, 200
RATE, RATE_WITH_KEY = 3.0, 10.0
ATTEMPTS, BASE_S, CAP_S, TIMEOUT_S = 6, 0.5, 120.0, 60.0
RETRIED = (429, 500, 502, 503, 504)
HIDDEN = ("api_key", "email")


class SourceError(RuntimeError):
    """The source answered with an error, or not at all."""


def rate(has_key: bool) -> float:
    return RATE_WITH_KEY if has_key else RATE


@dataclass
class RateLimiter:
    """At most `per_second` calls a second in this process (collect.shared_rate: so that several together keep to a rate)."""

    per_second: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    lock: threading.Lock = field(default_factory=threading.Lock)
    free_at: float = 0.0

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            if now < self.free_at:
                self.sleep(self.free_at - now)
                now = self.free_at
            self.free_at = now + 1.0 / self.per_second


def backoff(attempt: int, retry_after: float | None = None, jitter: Callable[[], float] = random.random) -> float:
    return min(CAP_S, max(BASE_S * 2**attempt + jitter() * BASE_S / 4, retry_after or 0.0))


def redacted(params: dict) -> dict:
    """For logs: secrets hidden, long values cut."""
    return {k: "***" if k in HIDDEN else (str(v)[:120] + "…" if len(str(v)) > 120 else v) for k, v in params.items()}


def get_text(send: Callable[[str, dict], tuple[int, dict, str]], url: str, params: dict, limiter: RateLimiter, sleep: Callable[[float], None] = time.sleep) -> str:
    """send gives (status, headers, text) or raises OSError. Transport errors, 429 and some 5xx are tried again; others fail at once."""
    said = ""
    for attempt in range(ATTEMPTS):
        limiter.acquire()
        wait = None
        try:
            status, headers, text = send(url, params)
            if status < 400:
                return text
            said = f"status {status}"
            if status not in RETRIED:
                break
            after = str(headers.get("Retry-After", ""))
            wait = float(after) if after.replace(".", "", 1).isdigit() else None
        except OSError as error:
            said = str(error)
        if attempt + 1 < ATTEMPTS:
            sleep(backoff(attempt, wait))
    raise SourceError(f"{url} {redacted(params)}: {said}")


def search_page(text: str) -> tuple[int, list[str]]:
    """(total, ids) of an answer; no ids, one id and other shapes are read as lists."""
    try:
        found = json.loads(text)["esearchresult"]
        ids = found.get("idlist")
        return int(found.get("count", 0)), [str(i) for i in ids] if isinstance(ids, list) else [] if ids is None else [str(ids)]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise SourceError(f"search answer not readable: {error}") from error


def search(page: Callable[[int, int], str], most: int) -> tuple[int, list[str]]:
    """(total, ids): pages until `most` or all are there, or a page is empty or short."""
    if most < 1:
        raise ValueError("the number of records asked for must be 1 or more")
    total, ids = 0, []
    while True:
        size = min(PAGE, most - len(ids))
        total, got = search_page(page(len(ids), size))
        ids += got
        if len(ids) >= min(most, total) or len(got) < size:
            return total, ids[:most]


def batches(ids: list[str], size: int = BATCH) -> list[list[str]]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


@dataclass
class FetchPartition(InputPartition):
    pos: int
    ids: list[str]


class FetchReader(DataSourceReader):
    """One partition a batch of ids; each reads its answer where it runs."""

    fetch: Callable[[list[str]], str]

    def __init__(self, ids: list[str], fetch: Callable[[list[str]], str]):
        self.ids, self.fetch = ids, fetch

    def partitions(self) -> list[InputPartition]:
        return [FetchPartition(i, b) for i, b in enumerate(batches(self.ids))] or [FetchPartition(0, [])]

    def read(self, partition: FetchPartition) -> Iterator[tuple]:
        if partition.ids:
            yield partition.pos, ",".join(partition.ids), self.fetch(partition.ids)


def fetch_source(name: str, fetch: Callable[[list[str]], str]) -> type[DataSource]:
    """A data source `name` of (pos, ids, xml) with the option "ids" (comma-joined); fetch gets a batch's answer."""

    class Fetch(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "pos long, ids string, xml string"

        def reader(self, schema) -> DataSourceReader:
            return FetchReader([i for i in self.options.get("ids", "").split(",") if i], fetch)

    return Fetch
