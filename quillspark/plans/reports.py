"""Reports as Markdown and JSON, and where they go. The driver formats what aggregates have made small; clusters come one by one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from quillspark.operators import records

METHOD = (
    "Groups are probable duplicates, for people to review. High: the same normal DOI, or the same normal title in the same known year. Medium: titles alike inside a block "
    "(and abstracts, where both have one), or embeddings alike. Evidence is listed by pair; groups can join through chains."
)


def duplicates_markdown(report: dict) -> Iterator[str]:
    """Lines of the report that operators.duplicates.report() gives; clusters are read one after another."""
    stats = report["stats"]
    yield from ("# Probable duplicate groups", "")
    for label, n in (("Source articles", report["source_article_count"]), ("Duplicate groups (size >= 2)", report["duplicate_group_count"]), ("Articles appearing in some group", report["articles_in_some_duplicate_group"]), ("Fuzzy pair comparisons", stats["fuzzy_pairs_compared"]), ("SPECTER 2 + FAISS edges added", stats["specter_pairs_added"])):
        yield f"- {label}: **{n}**"
    yield from ("", "## Definition (summary)", "", METHOD, "", "## Groups", "")
    for c in report["clusters"].orderBy("cluster_id").toLocalIterator():
        yield from (f"### Cluster {c.cluster_id} - `{c.primary_reason}` ({c.confidence})", "", c.detail, "")
        yield from listed("**Pairwise evidence:**", c.edge_evidence, after=True)
        if c.transitivity_note:
            yield from (f"*Note:* {c.transitivity_note}", "")
        yield from ("| PMID |", "|------|", *(f"| {p} |" for p in c.pmids))
        if c.reviewer_notes:
            yield ""
            yield from listed("**Reviewer notes:**", c.reviewer_notes, after=False)
        yield ""


def listed(head: str, items: Iterable[str], after: bool) -> list[str]:
    items = list(items)
    return [head, *(f"- {i}" for i in items), *([""] if after else [])] if items else []


def duplicates_json(report: dict) -> str:
    clusters = [c.asDict(recursive=True) for c in report["clusters"].drop("root", "n").orderBy("cluster_id").toLocalIterator()]
    return json.dumps({**{k: v for k, v in report.items() if k != "clusters"}, "methodology": METHOD, "clusters": clusters}, indent=2, ensure_ascii=False)


def insights_markdown(results: DataFrame, query: str | None, prompt_version: str, model: str, output: str) -> list[str]:
    """Counts and lists of results (idx, pmid, status, extraction)."""
    statuses = {r.status: r.n for r in records.status_counts(results).collect()}
    findings = {r.finding_direction: r.n for r in records.finding_counts(results, results["extraction.finding_direction.value"]).collect()}
    lists = {r.status: r.pmids for r in records.review_lists(results).collect()}
    counted = lambda d: [f"- `{k}`: **{d[k]}**" for k in sorted(d)]
    out = ["# Insight Output Report", "", "## Summary", f"- Source query: `{query or '(none)'}`", f"- Prompt version: `{prompt_version}`", f"- Model: `{model}`", f"- Total articles: **{sum(statuses.values())}**", "", "## Status counts", *counted(statuses)]
    out += ["", "## Finding direction distribution", *(counted(findings) or ["- No extracted findings (all rows skipped/failed)."]), "", "## Review / failure locations", f"- Full machine-readable output: `{output}`", "- In that file, inspect rows where `status` is one of:", *(f"  - `{s}`" for s in lists)]
    for head, status in (("PMIDs needing human review", "needs_human_review"), ("PMIDs with invalid output", "invalid_output"), ("PMIDs with API failures", "api_failure")):
        out += ["", f"### {head}", lists[status]]
    return out


def insights_path(given: str | None, lines: bool, folder: str = "output") -> Path:
    """A given path keeps .json and .jsonl and gets one of them otherwise; without one a name in the folder."""
    ending = ".jsonl" if lines else ".json"
    if not given:
        return (Path(folder) / f"insights{ending}").resolve()
    p = Path(given).expanduser()
    return (p if p.suffix.lower() in (".json", ".jsonl") else p.with_suffix(ending)).resolve()


def write_text(lines: Iterable[str], path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in lines)
