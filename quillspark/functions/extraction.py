"""Model output: strict parsing, local repair, audit verdicts. State machines over characters run in Python on Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.lazy import lazy_udf

BLOCK = "struct<value:string,confidence:double,evidence_spans:array<string>,reasoning_summary:string>"
EXTRACTION = f"struct<pmid:string,finding_direction:{BLOCK},statistical_significance:{BLOCK},clinical_meaningfulness:{BLOCK},main_claim:{BLOCK},review_flags:array<string>>"
FIELDS = ("finding_direction", "statistical_significance", "clinical_meaningfulness", "main_claim")
VERDICTS = ("supported", "weakly_supported", "unsupported")


def _number(x) -> float | None:
    """What a strict reader takes for a number: numbers, booleans, texts that spell one; only from 0 to 1."""
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return v if 0.0 <= v <= 1.0 else None


def parse(text: str) -> tuple[dict | None, str | None]:
    """The extraction, or what is wrong with the text."""
    try:
        data = json.loads(text)
    except ValueError as error:
        return None, f"json_decode_error:{error}"
    if not isinstance(data, dict):
        return None, "root_not_object"
    wrong = [] if isinstance(data.get("pmid"), str) else ["pmid"]
    out = {"pmid": data.get("pmid")}
    for field in FIELDS:
        block = data.get(field)
        if not isinstance(block, dict):
            wrong.append(field)
            continue
        spans, confidence, reasoning = block.get("evidence_spans", []), _number(block.get("confidence")), block.get("reasoning_summary")
        if not isinstance(block.get("value"), str):
            wrong.append(f"{field}.value")
        if confidence is None:
            wrong.append(f"{field}.confidence")
        if not isinstance(spans, list) or not all(isinstance(s, str) for s in spans):
            wrong.append(f"{field}.evidence_spans")
        if reasoning is not None and not isinstance(reasoning, str):
            wrong.append(f"{field}.reasoning_summary")
        out[field] = {"value": block.get("value"), "confidence": confidence, "evidence_spans": spans, "reasoning_summary": reasoning}
    flags = data.get("review_flags", [])
    if not isinstance(flags, list) or not all(isinstance(f, str) for f in flags):
        wrong.append("review_flags")
    out["review_flags"] = flags
    return (None, "schema_error:" + ",".join(wrong)) if wrong else (out, None)


def first_object(text: str) -> str | None:
    """The first balanced {...}; braces in strings don't count."""
    start = text.find("{")
    depth, quoted, at = 0, False, start
    while 0 <= at < len(text):
        m = re.compile(r'[\\"]' if quoted else r'[{}"]').search(text, at)
        if not m:
            return None
        at = m.end()
        if m[0] == "\\":
            at += 1
        elif m[0] == '"':
            quoted = not quoted
        else:
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[start:at]
    return None


def repair(text: str | None) -> str | None:
    """Without code fences, cut to the first object, without commas before a closing bracket; null unless an object comes of it."""
    if text is None or not text.strip():
        return None
    found = first_object(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text, flags=re.I).strip())
    if found is None:
        return None
    clean = re.sub(r",\s*([}\]])", r"\1", found)
    try:
        return clean if isinstance(json.loads(clean), dict) else None
    except ValueError:
        return None


@lazy_udf(f"struct<extraction:{EXTRACTION},error:string,repaired:boolean>", once=True)
def parsed(text: pd.Series) -> pd.DataFrame:
    """Parse; where that fails, repair locally and parse again."""
    rows = []
    for t in text:
        got, error = (None, None) if t is None else parse(t)
        fixed = repair(t) if got is None else None
        if fixed is not None:
            got, again = parse(fixed)
            error = None if got else again
        rows.append((got, error, got is not None and fixed is not None))
    return pd.DataFrame(rows, columns=["extraction", "error", "repaired"])


@lazy_udf("string")
def repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)


def audit_verdict(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*VERDICTS), v).otherwise(F.lit("unsupported"))
