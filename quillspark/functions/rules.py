"""Routing, label checks, grounding, contradiction rules and the final status, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.extraction import FIELDS
from quillspark.functions.text import collapse, strip

# Fixed values.
SKIP_TYPES = ("editorial", "comment", "news", "correction", "letter", "erratum")
LEAST_ABSTRACT = 40
LABELS = {
    "finding_direction": ("mixed", "negative", "neutral", "positive", "unclear"),
    "statistical_significance": ("not_significant", "significant", "unclear"),
    "clinical_meaningfulness": ("meaningful", "not_meaningful", "unclear"),
}
SIG_NEG = r"\b(no significant difference|not statistically significant|did not reach statistical significance|non[- ]significant)\b|\bp\s*>\s*0\.0?5\b"
SIG_POS = r"\b(p\s*<\s*0\.0?5|statistically significant|significant difference|significantly (higher|lower|reduced|improved))\b"
DIR_NEG = r"\b(no difference|failed to improve|did not improve|worse outcome|increased (risk|mortality|adverse)|harm)\b"
MAGNITUDE = r"\b(nnt|number needed|absolute risk|relative risk|hazard ratio|odds ratio|mean difference|md\b|effect size|clinically meaningful|patient[- ]important|quality of life|qol|nnt\b|% reduction)\b"
MESSAGES = {
    "mixed_significance_language": ("warning", "Evidence contains both significance and non-significance language; treat as ambiguous."),
    "sig_vs_evidence_neg": ("error", "Label significant but evidence text suggests non-significance language."),
    "not_sig_vs_evidence_pos": ("error", "Label not_significant but evidence suggests significance language."),
    "positive_vs_negative_language": ("warning", "Finding direction positive but negative/null language present in evidence/claim."),
    "meaningful_without_magnitude": ("warning", "Clinical meaningfulness is meaningful but no effect-size / patient-important language in evidence."),
}


def prefilter(abstract: Column, types: Column) -> Column:
    """struct<action, reason>: a missing or short abstract comes before the type of publication."""
    a = strip(F.coalesce(abstract, F.lit("")))
    skips = F.array(*(F.lit(k) for k in SKIP_TYPES))
    hit = F.try_element_at(F.flatten(F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.filter(skips, lambda k: F.contains(F.lower(t), k)))), F.lit(1))

    def out(action: str, reason: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), reason.cast("string").alias("reason"))

    return (
        F.when(a == "", out("minimal_unclear", F.lit("skipped_prefilter_no_abstract")))
        .when(F.length(a) < LEAST_ABSTRACT, out("minimal_unclear", F.lit("skipped_prefilter_short_abstract")))
        .when(hit.isNotNull(), out("skip", F.concat(F.lit("skipped_prefilter_non_primary_research:"), hit)))
        .otherwise(out("pass", F.lit(None)))
    )


def label_errors(x: Column) -> Column:
    """array<string>: what the labels of an extraction break."""
    checks = []
    for field, allowed in LABELS.items():
        v = F.lower(strip(x[field]["value"]))
        listed = "[" + ", ".join(f"'{a}'" for a in allowed) + "]"
        shown = F.when(F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"')), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'")))
        checks.append(F.when(~v.isin(*allowed), F.concat(F.lit(f"{field} must be one of {listed}, got "), shown)))
    checks.append(F.when(strip(x["main_claim"]["value"]) == "", F.lit("main_claim.value must be non-empty")))
    return F.array_compact(F.array(*checks))


def span_found(span: Column, text: Column, flat: Column | None = None) -> Column:
    """The stripped span is in the text, as it is or with white space collapsed in both. flat: the collapsed text, where it is a
    column already and need not be made for each span."""
    s = strip(span)
    return (s != "") & (F.contains(text, s) | F.contains(collapse(text) if flat is None else flat, collapse(s)))


def missing_spans(block: Column, text: Column, flat: Column | None = None) -> Column:
    """array<string> of a field's spans that the text doesn't hold. A value that is unclear needs none."""
    spans = F.coalesce(block["evidence_spans"], F.array().cast("array<string>"))
    unclear = F.lower(strip(block["value"])) == "unclear"
    lost = F.filter(spans, lambda s: (strip(s) != "") & ~span_found(s, text, flat))
    named = F.transform(F.filter(spans, lambda s: ~span_found(s, text, flat)), lambda s: F.when(strip(s) == "", F.lit("<empty span>")).otherwise(s))
    return F.when(unclear, lost).when(F.size(spans) == 0, F.array(F.lit("<no evidence span provided>"))).otherwise(named)


def grounding(x: Column, text: Column, flat: Column | None = None) -> Column:
    def one(field: str) -> Column:
        missing = missing_spans(x[field], text, flat)
        return F.struct(F.lit(field).alias("field_name"), (F.size(missing) == 0).alias("all_spans_found"), missing.alias("missing_spans"))

    return F.array(*(one(f) for f in FIELDS))


def _evidence(x: Column) -> Column:
    return F.lower(F.array_join(F.concat(*(F.coalesce(x[f]["evidence_spans"], F.array().cast("array<string>")) for f in FIELDS)), " "))


def semantic_codes(x: Column) -> Column:
    """array<string> of rule codes in fixed order."""
    ev, claim = _evidence(x), F.lower(x["main_claim"]["value"])
    v, d, m = (F.lower(x[f]["value"]) for f in FIELDS[1::-1] + FIELDS[2:3])
    negative, positive = ev.rlike(SIG_NEG), F.regexp_replace(ev, SIG_NEG, " ").rlike(SIG_POS)
    significance = (
        F.when(negative & positive, F.lit("mixed_significance_language"))
        .when((v == "significant") & negative, F.lit("sig_vs_evidence_neg"))
        .when((v == "not_significant") & positive, F.lit("not_sig_vs_evidence_pos"))
    )
    reasoning = F.lower(F.coalesce(x["clinical_meaningfulness"]["reasoning_summary"], F.lit("")))
    return F.array_compact(F.array(
        significance,
        F.when((d == "positive") & (ev.rlike(DIR_NEG) | claim.rlike(DIR_NEG)), F.lit("positive_vs_negative_language")),
        F.when((m == "meaningful") & ~ev.rlike(MAGNITUDE) & ~reasoning.rlike(MAGNITUDE), F.lit("meaningful_without_magnitude")),
    ))


def semantic_flags(codes: Column) -> Column:
    """array<struct<code, message, severity>>."""
    info = F.create_map(*(F.lit(v) for k, (s, m) in MESSAGES.items() for v in (k, f"{s}\x00{m}")))
    part = lambda c, i: F.split(F.try_element_at(info, c), "\x00")[i]
    return F.transform(codes, lambda c: F.struct(c.alias("code"), part(c, 1).alias("message"), part(c, 0).alias("severity")))


def second_pass(x: Column, text: Column, flat: Column | None = None) -> dict[str, Column]:
    """What is checked of an extraction against its record's text; verdict() takes these as columns."""
    return {"schema_errors": label_errors(x), "grounding": grounding(x, text, flat), "codes": semantic_codes(x)}


def verdict(x: Column, errors: Column, ground: Column, codes: Column, threshold: float = 0.5, too_long: Column | None = None) -> dict[str, Column]:
    """Named columns that follow from second_pass()."""
    too_long = F.lit(False) if too_long is None else too_long
    schema_ok, ground_ok = F.size(errors) == 0, F.forall(ground, lambda g: g["all_spans_found"])
    error = F.exists(codes, lambda c: c.isin("sig_vs_evidence_neg", "not_sig_vs_evidence_pos"))
    low = reduce(lambda a, b: a | b, (x[f]["confidence"] < threshold for f in FIELDS))
    notable = (F.lower(x["finding_direction"]["value"]) == "mixed") | (F.lower(x["clinical_meaningfulness"]["value"]) == "meaningful")
    review = ~schema_ok | ~ground_ok | error | too_long | (F.size(codes) > 0) | notable
    reasons = F.array_compact(F.array(
        F.when(~schema_ok, F.lit("schema_validation_failed")), F.when(~ground_ok, F.lit("grounding_failed")), F.when(F.size(codes) > 0, F.lit("semantic_flags_present")),
        F.when(low, F.lit("low_confidence_triage")), F.when(notable, F.lit("audit_recommended")), F.when(~review, F.lit("auto_accept_eligible")),
    ))
    return {
        "schema_ok": schema_ok, "grounding_ok": ground_ok, "truncation_warning": too_long, "auto_accept": F.when(review, F.lit("needs_human_review")).otherwise(F.lit("auto_accept")),
        "acceptance_reasons": reasons, "audit_wanted": notable | (F.size(codes) > 0),
    }


def final_status(auto_accept: Column, schema_ok: Column, grounding_ok: Column, audit_supported: Column) -> Column:
    """audit_supported is null where there was no audit."""
    fine = schema_ok & grounding_ok & F.coalesce(audit_supported, F.lit(True))
    return (
        F.when(~grounding_ok, F.lit("invalid_output")).when(fine & (auto_accept == "auto_accept"), F.lit("auto_accepted")).when(fine, F.lit("validated_but_flagged")).otherwise(F.lit("needs_human_review"))
    )
