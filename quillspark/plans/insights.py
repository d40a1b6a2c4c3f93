"""From records to checked claims: route, extract (a pluggable model call), parse, validate, audit, status."""

from __future__ import annotations

import concurrent.futures as futures
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as t
from quillspark.functions.checkpoints import written
from quillspark.functions.extraction import FIELDS, parsed
from quillspark.functions.messages import audited

# Fixed values.
ATTEMPTS, PAUSE_S, CALLS_AT_ONCE = 3, 0.5, 8
CANONICAL_CHARS, RAW_CHARS, AUDIT_CHARS = 12_000, 8000, 12_000
MINIMAL_STATUS, MINIMAL_REASON = "validated_but_flagged", "prefilter_minimal_unclear"

#: A model call: (prompt) -> (text, input tokens, output tokens). It is sent to the executors.
Model = Callable[[str], tuple[str, int, int]]


def prompt_parts() -> tuple[str, ...]:
    """What stands before the id, title, abstract, types and keywords of a request, and after them."""
    labels = "\n".join(f"- {k}: {' | '.join(v)}" for k, v in rules.LABELS.items())
    shape = json.dumps({"pmid": "<id>", **{f: {"value": "<label>", "confidence": 0.0, "evidence_spans": ["<quote>"]} for f in FIELDS}, "review_flags": []})
    return ("Label this record from its title and abstract alone.\n\nPMID: ", "\nTitle: ", "\nAbstract: ", "\nPublication types: ", "\nKeywords: ", f"\n\nLabels:\n{labels}\n\nAnswer with one JSON object of this shape, quotes verbatim: {shape}")


def user_prompt(pmid: Column, title: Column, abstract: Column, types: Column, keywords: Column) -> Column:
    """The request for one record: its fields, the labels allowed, the answer's shape."""
    listed = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(c, ", ")).otherwise(F.lit("(none)"))
    *before, after = map(F.lit, prompt_parts())
    fields = (pmid, F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), listed(types), listed(keywords))
    return F.concat(*(c for pair in zip(before, fields, strict=True) for c in pair), after)


def route(records: DataFrame) -> DataFrame:
    """records with action, reason, canonical text and its hash."""
    out = records.withColumn("route", rules.prefilter(F.col("abstract"), F.col("publication_types")))
    out = out.withColumns({"action": F.col("route.action"), "reason": F.col("route.reason"), "canonical": t.canonical(F.col("title"), F.col("abstract"))}).drop("route")
    return out.withColumn("input_hash", t.input_hash(F.col("canonical")))


def call_model(rows: DataFrame, prompt: str, model: Model, sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> DataFrame:
    """rows with raw, call_error and token counts: some calls at once in each task, each tried a few times."""

    def one(text: str) -> tuple[str | None, str | None, int, int]:
        said = None
        for n in range(attempts):
            try:
                said_text, read, made = model(text)
                return said_text, None, read, made
            except Exception as error:  # noqa: BLE001 a model's client may raise anything; the row keeps what it said
                said = str(error)
                if n + 1 < attempts:
                    sleep(PAUSE_S * 2**n)
        return None, said, 0, 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with futures.ThreadPoolExecutor(CALLS_AT_ONCE) as pool:
            for pdf in frames:
                got = list(pool.map(one, pdf[prompt]))
                yield pdf[["idx"]].assign(raw=[g[0] for g in got], call_error=[g[1] for g in got], input_tokens=[g[2] for g in got], output_tokens=[g[3] for g in got])

    answers = rows.select("idx", prompt).mapInPandas(run, "idx long, raw string, call_error string, input_tokens long, output_tokens long")
    return rows.join(written(answers, "answers"), "idx")


def finish(rows: DataFrame, threshold: float = 0.5, most_chars: int | None = CANONICAL_CHARS, audit: Column | None = None) -> DataFrame:
    """(idx, pmid, status, ...) of rows with action, reason, canonical, raw and call_error; audit: a boolean of what an audit said, null
    where there was none."""
    done = rows.withColumn("parsed", parsed("raw"))
    x, long = F.col("parsed.extraction"), F.coalesce(F.length("canonical") > most_chars, F.lit(False)) if most_chars is not None else F.lit(False)
    done = done.withColumn("flat", t.collapse(F.col("canonical")))
    done = done.withColumns(rules.second_pass(x, F.col("canonical"), F.col("flat")))
    done = done.withColumns(rules.verdict(x, F.col("schema_errors"), F.col("grounding"), F.col("codes"), threshold, long))
    status = (
        F.when(F.col("action") == "skip", F.lit("skipped_prefilter"))
        .when(F.col("action") == "minimal_unclear", F.lit(MINIMAL_STATUS))
        .when(F.col("raw").isNull(), F.lit("api_failure"))
        .when(x.isNull(), F.lit("invalid_output"))
        .otherwise(rules.final_status(F.col("auto_accept"), F.col("schema_ok"), F.col("grounding_ok"), F.lit(None).cast("boolean") if audit is None else audit))
    )
    minimal = F.col("action") == "minimal_unclear"
    validated = (F.col("action") == "pass") & x.isNotNull()
    return done.select(
        "idx", "pmid", status.alias("status"), "input_hash", F.when(validated, x).alias("extraction"),
        F.when(minimal, F.lit("needs_human_review")).when(validated, F.col("auto_accept")).alias("auto_accept"),
        F.when(minimal, F.array(F.lit(MINIMAL_REASON), F.col("reason"))).when(validated, F.col("acceptance_reasons")).alias("acceptance_reasons"),
        F.when(validated, F.col("schema_errors")).alias("schema_errors"), F.when(validated, F.col("grounding")).alias("grounding"), F.when(validated, F.col("codes")).alias("semantic_codes"),
        F.coalesce(validated & F.col("audit_wanted"), F.lit(False)).alias("audit_wanted"), F.when(F.col("action") != "pass", F.col("reason")).alias("prefilter_note"), F.coalesce(validated & F.col("truncation_warning"), F.lit(False)).alias("truncated"),
        F.coalesce("call_error", F.col("parsed.error")).alias("error"), F.left(F.col("raw"), F.lit(RAW_CHARS)).alias("raw_text"), F.lit(t.PROMPT_VERSION).alias("prompt_version"), F.lit(t.VALIDATOR_VERSION).alias("validator_version"),
    )


def repair_prompt(raw: str) -> str:
    """The request for an answer that doesn't parse: raw, which comes last, as one JSON object."""
    return f"Give this answer as the one JSON object that was asked for, without any other text and without new content:\n\n{raw}"


def audit_prompt(pmid: Column, title: Column, abstract: Column, extraction: Column) -> Column:
    shape = json.dumps({"supported": True, **dict.fromkeys(FIELDS, "supported | weakly_supported | unsupported"), "notes": ["<reason>"]})
    return F.concat(
        F.lit("Do the quotes bear out this labelling?\n\nPMID: "), pmid, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")),
        F.lit("\nLabelling: "), F.left(F.to_json(extraction), F.lit(AUDIT_CHARS)), F.lit(f"\n\nAnswer with one JSON object of this shape: {shape}"),
    )


def run_audit(rows: DataFrame, results: DataFrame, model: Model) -> DataFrame:
    """rows with audit (null where none was wanted); a call that fails, or an answer that doesn't parse, supports nothing."""
    wanted = rows.join(results.where("audit_wanted").select("idx", "extraction"), "idx")
    asked = wanted.select("idx", audit_prompt(F.col("pmid"), F.col("title"), F.col("abstract"), F.col("extraction")).alias("prompt"))
    said = call_model(written(asked, "audits"), "prompt", model, attempts=1)
    found = said.select("idx", audited("raw", "call_error").alias("audit"), F.col("input_tokens").alias("audit_read"), F.col("output_tokens").alias("audit_made"))
    return rows.join(written(found, "audited"), "idx", "left")


def run(records: DataFrame, model: Model, name: str, cache: DataFrame | None = None, repair: Callable[[str], str] | None = None, threshold: float = 0.5, audit_model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows (k, v, pos)) of records (idx, pmid, title, abstract, publication_types, keywords). Cached answers are
    validated again; only answers that parse are cached. audit_model is asked about labels that call for it. repair makes a prompt of a text that doesn't parse, for one more call."""
    rows = written(route(records).withColumn("k", t.cache_key(F.col("pmid"), name, F.col("input_hash"))), "routed")
    known = (rows.join(cache.withColumnRenamed("v", "cached"), "k", "left") if cache is not None else rows.withColumn("cached", F.lit(None).cast("string"))).withColumn("prompt", user_prompt(F.col("pmid"), F.col("title"), F.col("abstract"), F.col("publication_types"), F.col("keywords")))
    ask = (F.col("action") == "pass") & F.col("cached").isNull()
    empty = {"raw": F.when(F.col("action") == "pass", F.col("cached")), "call_error": F.lit(None).cast("string"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long")}
    asked = call_model(known.where(ask), "prompt", model)
    if repair is not None:
        asked = asked.withColumn("bad", F.col("raw").isNotNull() & parsed("raw")["extraction"].isNull())
        again = asked.where("bad").withColumn("prompt", F.concat(F.lit(repair("")), F.col("raw"))).drop("raw", "call_error", "input_tokens", "output_tokens")
        asked = asked.where("not bad").drop("bad").unionByName(call_model(again.drop("bad"), "prompt", model, attempts=1))
    everything = written(asked.unionByName(known.where(~ask).withColumns(empty)), "answered")
    if audit_model is None:
        out = finish(everything, threshold).join(everything.select("idx", "input_tokens", "output_tokens"), "idx")
    else:
        checked = run_audit(everything, finish(everything, threshold), audit_model)
        tokens = (F.col(c) + F.coalesce(a, F.lit(0)) for c, a in (("input_tokens", "audit_read"), ("output_tokens", "audit_made")))
        out = finish(checked, threshold, audit=F.col("audit.supported")).join(checked.select("idx", "audit", *(t.alias(c) for t, c in zip(tokens, ("input_tokens", "output_tokens"), strict=True))), "idx")
    fresh = everything.where(F.col("cached").isNull() & F.col("raw").isNotNull()).withColumn("fine", parsed("raw")["extraction"].isNotNull()).where("fine").select("k", F.col("raw").alias("v"), F.col("idx").alias("pos"))
    return out, fresh
