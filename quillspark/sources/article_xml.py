"""Article records from XML, namespaces ignored: each record element becomes a row, unreadable ones go to a side table."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.schemas import RECORD

#: Rows that go back to Spark at once.
MOST_ROWS = 5000
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _name(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _all(el: ET.Element | None, path: str) -> list[ET.Element]:
    """Descendants along a path of child names."""
    found = [] if el is None else [el]
    for step in path.split("/"):
        found = [c for f in found for c in f if _name(c) == step]
    return found


def _one(el: ET.Element | None, path: str) -> ET.Element | None:
    for step in path.split("/"):
        el = next((c for c in el if _name(c) == step), None) if el is not None else None
    return el


def direct(el: ET.Element | None) -> str | None:
    """Text before the first child element, stripped; null if blank."""
    return ((el.text or "").strip() or None) if el is not None else None


def whole(el: ET.Element) -> str:
    return "".join(el.itertext()).strip()


def segments(el: ET.Element | None, child: str) -> str | None:
    """Labelled parts, a blank line between them; without parts the element's own text."""
    if el is None:
        return None
    parts = [f"{p.get('Label')}: {whole(p)}".strip() if p.get("Label") else whole(p) for p in _all(el, child)]
    return "\n\n".join(p for p in parts if p) if parts else direct(el)


def month(text: str | None) -> int | None:
    s = (text or "").strip()
    if s.isdigit():
        return int(s) if 1 <= int(s) <= 12 else None
    return MONTHS.index(s[:3].lower()) + 1 if s[:3].lower() in MONTHS else None


def _int(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def record(el: ET.Element) -> dict:
    """One record; ValueError if the element has no citation or no id."""
    citation = _one(el, "MedlineCitation")
    if citation is None:
        raise ValueError("no citation")
    pmid = direct(_one(citation, "PMID"))
    if not pmid:
        raise ValueError("no id")
    art = _one(citation, "Article")
    date = _one(art, "Journal/JournalIssue/PubDate")
    ids = _all(el, "PubmedData/ArticleIdList/ArticleId")
    of_kind = lambda kind: next((direct(i) for i in reversed(ids) if i.get("IdType") == kind and direct(i)), None)
    elocation = next((direct(e) for e in _all(art, "ELocationID") if e.get("EIdType") == "doi" and direct(e)), None)
    mesh = []
    for h in _all(citation, "MeshHeadingList/MeshHeading"):
        terms = [t for t in [direct(_one(h, "DescriptorName")), *(direct(q) for q in _all(h, "QualifierName"))] if t]
        mesh += [" / ".join(terms)] if terms else []
    return {
        "pmid": pmid, "title": direct(_one(art, "ArticleTitle")), "abstract": segments(_one(art, "Abstract"), "AbstractText"), "journal_full": direct(_one(art, "Journal/Title")), "journal_iso": direct(_one(art, "Journal/ISOAbbreviation")),
        "publication_year": _int(direct(_one(date, "Year"))), "publication_month": month(direct(_one(date, "Month"))), "publication_day": _int(direct(_one(date, "Day"))),
        "doi": elocation or of_kind("doi"), "pmc_id": of_kind("pmc"), "language": direct(_one(art, "Language")),
        "publication_types": [t for t in map(direct, _all(art, "PublicationTypeList/PublicationType")) if t], "mesh_terms": mesh, "keywords": [t for t in map(direct, _all(citation, "KeywordList/Keyword")) if t],
        "authors": [{"last_name": direct(_one(a, "LastName")), "fore_name": direct(_one(a, "ForeName")), "initials": direct(_one(a, "Initials")), "affiliation": direct(_one(a, "AffiliationInfo/Affiliation"))} for a in _all(art, "AuthorList/Author")],
    }


def fallback_id(el: ET.Element) -> str | None:
    return next((direct(e) for e in el.iter() if _name(e) == "PMID" and direct(e)), None)


def in_band_error(text: str) -> str | None:
    """What <ERROR> elements of an answer say."""
    said = [m.strip() for m in re.findall(r"(?is)<ERROR[^>]*>([^<]+)</ERROR>", text)]
    return ("; ".join(s for s in said if s) or "unknown error") if re.search(r"(?i)<ERROR\b", text) else None


def record_elements(text: str) -> Iterator[ET.Element]:
    """The record elements of a document one after another; each, and what stands before it, is dropped when the next is asked for."""
    depth, holders = 0, []
    for event, el in ET.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
        if event == "start":
            holders.append(el)
            depth += _name(el) == "PubmedArticle"
            continue
        holders.pop()
        if _name(el) == "PubmedArticle":
            depth -= 1
            if depth == 0:
                yield el
                for holder in holders:
                    holder.clear()


def parse_documents(docs: DataFrame, text_col: str = "xml", place: str = "pos") -> DataFrame:
    """(pos, nth, record, warning) of each record element of each document (pos, xml); record or warning is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for pos, text in zip(pdf[place], pdf[text_col], strict=True):
                own: list[tuple] = []
                try:
                    for n, el in enumerate(record_elements(text or "")):
                        try:
                            own.append((pos, n, json.dumps(record(el)), None))
                        except ValueError as error:
                            own.append((pos, n, None, f"skipped record {fallback_id(el) or '(no id)'}: {error}"))
                except ET.ParseError as error:  # a document counts as a whole
                    own = [(pos, 0, None, f"document not readable: {error}")]
                rows += own
                if len(rows) >= MOST_ROWS:
                    yield pd.DataFrame(rows, columns=["pos", "nth", "record", "warning"])
                    rows = []
            yield pd.DataFrame(rows, columns=["pos", "nth", "record", "warning"])

    out = docs.select(place, text_col).mapInPandas(run, "pos long, nth int, record string, warning string")
    return out.withColumn("record", F.from_json("record", RECORD))
