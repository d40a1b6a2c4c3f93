"""What a service or a command line needs around the library: checked requests, answers that name files, folders, model clients."""

from __future__ import annotations

import datetime
import importlib
import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.providers import LOCAL, Registry, Resolution

log = logging.getLogger(__name__)

# Limits of requests, the exit code of a wrong command, clients of the providers and what binds them to JSON.
MOST_AT_ONCE, USAGE_ERROR, STAGE_READY = 64, 2, "ready"
CLIENTS = {"openai": ("langchain_openai", "ChatOpenAI", "model"), "gemini": ("langchain_google_genai", "ChatGoogleGenerativeAI", "model"), "claude": ("langchain_anthropic", "ChatAnthropic", "model_name"), "ollama": ("langchain_ollama", "ChatOllama", "model")}
JSON_MODE = {"openai": {"response_format": {"type": "json_object"}}, "gemini": {"response_mime_type": "application/json"}, "claude": {"response_format": {"type": "json_object"}}}


class RequestError(ValueError):
    """A request that can't be served as it is."""


class UsageError(RequestError):
    """The same for a command; code is its exit code."""

    code = USAGE_ERROR


def _check(ok: bool, said: str) -> None:
    if not ok:
        raise RequestError(said)


@dataclass(frozen=True)
class CollectRequest:
    query: str
    count: int = 100
    api_key: str | None = None
    email: str | None = None
    tool: str = "quillspark"
    output_path: str | None = None

    def __post_init__(self):
        _check(len(self.query) >= 1, "query must have 1 character or more")
        _check(self.count >= 1, "count must be 1 or more")
        _check(len(self.tool) >= 1, "tool must have 1 character or more")


@dataclass(frozen=True)
class InsightRequest:
    collection_path: str
    llm: str | None = None
    model: str | None = None
    concurrency: int = 8
    enable_audit: bool = True
    confidence_threshold: float = 0.5
    progress_every: int = 1
    lines: bool = False

    def __post_init__(self):
        _check(len(self.collection_path) >= 1, "collection_path must have 1 character or more")
        _check(1 <= self.concurrency <= MOST_AT_ONCE, f"concurrency must be from 1 to {MOST_AT_ONCE}")
        _check(0.0 <= self.confidence_threshold <= 1.0, "confidence_threshold must be from 0 to 1")
        _check(self.progress_every >= 1, "progress_every must be 1 or more")

    def resolution(self, registry: Registry, env: Mapping[str, str]) -> Resolution:
        return registry.request((self.llm or "").strip().lower() or None, self.model, env)


@dataclass(frozen=True)
class FilesWritten:
    """The answer to a request whose results went to files: logical names and absolute paths."""

    paths: dict[str, str]
    output_format: str = field(default="file", init=False)


@dataclass(frozen=True)
class DuplicatesAnswer:
    report: dict
    markdown: str | None = None


def write_results(texts: Mapping[str, tuple[Path, str]]) -> FilesWritten:
    """Writes each named text to its path; folders are made."""
    for path, text in texts.values():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return FilesWritten({name: str(path.resolve()) for name, (path, _) in texts.items()})


def wanted_query(words: list[str]) -> str:
    query = " ".join(words).strip()
    if not query:
        raise UsageError("the query is empty")
    return query


def wanted_provider(name: str | None, registry: Registry, env: Mapping[str, str]) -> Resolution:
    if not (name or "").strip():
        raise UsageError("a provider must be named for labels")
    try:
        return registry.resolve(name, env)
    except KeyError:
        raise UsageError(f"no provider is named {name.strip().lower()!r}") from None


def project_root(start: Path | None = None, mark: str = "pyproject.toml") -> Path:
    """The working folder if it has the mark, else the nearest folder above `start` that has it, else the working folder."""
    here = Path.cwd()
    above = (start or Path(__file__)).resolve()
    return next((d for d in (here, above, *above.parents) if (d / mark).is_file()), here)


def run_folder(root: Path, now: datetime.datetime) -> Path:
    return root / f"workflow_{now:%Y%m%d_%H%M%S}"


def chat_client(resolution: Resolution, load: Callable[[str], object] = importlib.import_module, temperature: float = 0.0, **options):
    """The client of a provider, from the package that has it; ValueError for a provider without one."""
    if resolution.provider not in CLIENTS:
        raise ValueError(f"no client is known for {resolution.provider}")
    package, kind, model = CLIENTS[resolution.provider]
    if resolution.provider == "ollama":
        options["base_url"] = str(resolution.extra.get("base_url", LOCAL))
    return getattr(load(package), kind)(**{model: resolution.model_id, "temperature": temperature, **options})


def in_json_mode(client, provider: str):
    """The client bound to JSON answers, where its provider has such a mode and it takes it."""
    if provider not in JSON_MODE:
        return client
    try:
        return client.bind(**JSON_MODE[provider])
    except (TypeError, ValueError):
        if provider == "openai":
            raise
        return client


def stats_line(totals: Mapping[str, int | None]) -> str:
    """Counts of a job (operators.records.job_totals) on one line."""
    shown = {"auto_accepted": "auto_accepted", "validated_flagged": "validated_but_flagged", "needs_review": "needs_review", "invalid": "invalid_output", "api_fail": "api_failures", "skipped": "skipped_prefilter", "trunc_warn": "truncation_warning", "tokens_in": "input_tokens", "tokens_out": "output_tokens"}
    return "Stats: " + " ".join(f"{k}={int(totals.get(c) or 0)}" for k, c in shown.items())


def insights_summary(totals: Mapping[str, int | None], query: str | None, prompt_version: str, model: str) -> str:
    """The summary that goes beside a file of JSON lines."""
    return json.dumps({"query": query, "prompt_version": prompt_version, "model": model, "stats": dict(totals)}, indent=2, ensure_ascii=False)


class Progress:
    """Tells of every n-th completion and the last."""

    def __init__(self, total: int, every: int = 1, tell: Callable[[str], None] = log.info):
        self.total, self.every, self.tell, self.done = total, max(1, every), tell, 0

    def completed(self, n: int = 1) -> None:
        before, self.done = self.done, self.done + n
        if self.done >= self.total or self.done // self.every > before // self.every:
            self.tell(f"{self.done} of {self.total} records are done")


def mark_ready(records: DataFrame) -> DataFrame:
    """(pmid, stage): the first stage of a job's graph, which only says that a record is ready."""
    return records.select("pmid", F.lit(STAGE_READY).alias("stage"))
