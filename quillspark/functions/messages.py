"""What a model's client gives back: texts, token usage, audits."""

from __future__ import annotations

import json

import pandas as pd

from quillspark.functions.extraction import FIELDS, VERDICTS
from quillspark.functions.lazy import lazy_udf

AUDIT = "struct<supported:boolean," + ",".join(f"{f}:string" for f in FIELDS) + ",notes:array<string>>"
#: Names that clients use for tokens read and made.
READ, MADE = ("prompt_tokens", "input_tokens", "input_token_count"), ("completion_tokens", "output_tokens", "output_token_count")


def content(message: object) -> str:
    """A text, or the texts of a list of blocks one after another."""
    if isinstance(message, str):
        return message
    if isinstance(message, list):
        return "".join(str(b.get("text", "")) if isinstance(b, dict) and b.get("type") == "text" else str(b) for b in message)
    return str(message)


def usage(own: object, answer: object) -> tuple[int, int]:
    """Tokens read and made: of the message's own account, else of the answer's."""

    def of(account: object) -> tuple[int, int]:
        first = lambda names: next((int(account[n]) for n in names if account.get(n)), 0)
        return (first(READ), first(MADE)) if isinstance(account, dict) else (0, 0)

    found = of(own)
    meta = answer if isinstance(answer, dict) else {}
    return found if any(found) else of(meta.get("token_usage") or meta.get("usage"))


def audit(text: str | None) -> dict | None:
    """An audit's answer; null if it isn't a JSON object. Verdicts that aren't known count as unsupported."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    verdict = lambda f: v if (v := str(data.get(f, "")).strip().lower()) in VERDICTS else "unsupported"
    notes = data.get("notes")
    notes = notes if isinstance(notes, list) else [] if notes is None else [notes]
    return {"supported": bool(data.get("supported", False)), **{f: verdict(f) for f in FIELDS}, "notes": [s for n in notes if (s := str(n).strip())]}


def failed_audit(why: str) -> dict:
    return {"supported": False, **dict.fromkeys(FIELDS, "unsupported"), "notes": [why]}


@lazy_udf(AUDIT, once=True)
def audited(text: pd.Series, error: pd.Series) -> pd.DataFrame:
    rows = [failed_audit(f"audit_error:{e}") if e is not None else audit(t) or failed_audit("audit_parse_failed") for t, e in zip(text, error, strict=True)]
    return pd.DataFrame(rows, columns=["supported", *FIELDS, "notes"])
