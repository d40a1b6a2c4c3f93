"""Sources, model output, rules, plans and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import extraction, messages, rules
from quillspark.functions import text as t
from quillspark.plans import insights, reports
from quillspark.plans.providers import Registry
from quillspark.sources import article_xml, files, paged


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [("HTTPS://DOI.ORG/10.9/Q;)", "10.9/q"), ("doi: 10.9/q", "10.9/q"), ("", None), (None, None), ("https://doi.org/doi:10.1/x", "10.1/x"), (" 10.1/x\t", "10.1/x")])
def test_doi(spark, given, want):
    assert value(spark, t.doi(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("A -- B!", "a b"), (None, ""), ("naïve", "nai ve"), ("x_y  😀 z", "x_y z")])
def test_title(spark, given, want):
    assert value(spark, t.title(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("Feb", 2), ("11", 11), ("Sept", 9), ("Winter", None), ("0", None), ("99", None), (None, None)])
def test_month(given, want):
    assert article_xml.month(given) == want


@pytest.mark.parametrize(("given", "want"), [('{"k":[1,],}', '{"k":[1]}'), ("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("none", None), ("", None), (None, None), ('x {"a": "}{\\"", "b": 2} y', '{"a": "}{\\"", "b": 2}'), ('{"a": {', None)])
def test_repair(given, want):
    assert extraction.repair(given) == want


def answer(**change):
    block = lambda v: {"value": v, "confidence": 0.9, "evidence_spans": ["good results"]}
    return {"pmid": "1", "finding_direction": block("positive"), "statistical_significance": block("significant"), "clinical_meaningfulness": block("not_meaningful"), "main_claim": block("it works"), "review_flags": []} | change


def test_strict_parse():
    assert extraction.parse(json.dumps(answer()))[1] is None
    assert extraction.parse(json.dumps(answer(pmid=1)))[0] is None
    assert extraction.parse("[1]")[1] == "root_not_object"
    bad = answer()
    bad["main_claim"] = bad["main_claim"] | {"confidence": 1.5}
    assert "main_claim.confidence" in extraction.parse(json.dumps(bad))[1]


def test_labels_fixed():
    assert rules.LABELS["finding_direction"][0] == "mixed"


def test_xml(spark):
    doc = """<Set xmlns="urn:x"><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>Plain <i>x</i></ArticleTitle><Abstract><AbstractText Label="AIM">a <b>b</b></AbstractText><AbstractText/><AbstractText>c</AbstractText></Abstract>
    <Journal><JournalIssue><PubDate><Year>2001</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><ELocationID EIdType="doi">10.1/e</ELocationID></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>D</DescriptorName><QualifierName>q</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">P1</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
    <PubmedArticle><MedlineCitation/></PubmedArticle></Set>"""
    rows = article_xml.parse_documents(spark.createDataFrame([(0, doc), (1, "<broken"), (2, None)], "pos long, xml string")).orderBy("pos", "nth").collect()
    r = rows[0].record
    assert (r.pmid, r.title, r.abstract, r.publication_year, r.publication_month, r.doi, r.pmc_id, r.mesh_terms) == ("7", "Plain", "AIM: a b\n\nc", 2001, 3, "10.1/e", "P1", ["D / q"])
    assert [x.warning is None for x in rows] == [True, False, False, False]
    assert article_xml.in_band_error("<ERROR>a</ERROR><error> b </error>") == "a; b" and article_xml.in_band_error("<ok/>") is None


def test_collection_round_trip(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"query": "q", "total_match_count": 2, "articles": [{"pmid": "1", "title": "T", "publication_month": 3}, {"pmid": "2", "unknown": 1}], "warnings": []}))
    rows, header = files.read_collection(spark, str(p))
    assert [r.pmid for r in rows.orderBy("idx").collect()] == ["1", "2"] and header.first()["query"] == "q" and rows.first().keywords == []
    doc = files.collection_document(rows, {"query": "q"}).first()
    assert doc.retrieved_count == 2 and doc.articles[1].pmid == "2"
    p.write_text(json.dumps({"articles": [{"pmid": "1", "publication_month": 13}]}))
    with pytest.raises(Exception, match="month"):
        files.read_collection(spark, str(p))[0].collect()
    assert files.read_cache(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    assert files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2


def test_paged_search_and_retries():
    ids = [str(i) for i in range(25_000)]
    page = lambda start, size: json.dumps({"esearchresult": {"count": str(len(ids)), "idlist": ids[start : start + size]}})
    assert paged.search(page, 12_345) == (25_000, ids[:12_345])
    assert paged.search(lambda s, n: '{"esearchresult": {"count": "3", "idlist": null}}', 5) == (3, [])
    with pytest.raises(paged.SourceError):
        paged.search_page("[]")
    with pytest.raises(ValueError):
        paged.search(page, 0)
    said, slept = [(503, {"Retry-After": "2"}, ""), (200, {}, "ok")], []
    limiter = paged.RateLimiter(1000.0)
    assert paged.get_text(lambda u, p: said.pop(0), "u", {}, limiter, slept.append) == "ok" and slept == [2.0]
    with pytest.raises(paged.SourceError, match=r"\*\*\*"):
        paged.get_text(lambda u, p: (404, {}, ""), "u", {"api_key": "secret"}, limiter, slept.append)
    assert paged.backoff(20) == paged.CAP_S and [len(b) for b in paged.batches(ids[:401])] == [200, 200, 1] and paged.rate(True) == 10


def test_fetch_source(spark):
    source = paged.fetch_source("fake_fetch", lambda ids: "<S>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID></MedlineCitation></PubmedArticle>" for i in ids) + "</S>")
    spark.dataSource.register(source)
    got = article_xml.parse_documents(spark.read.format("fake_fetch").option("ids", ",".join(map(str, range(450)))).load())
    assert got.where("record is not null").count() == 450


def test_providers():
    r = Registry({"openai": "a", "gemini": "b", "claude": "c", "ollama": "d"})
    assert r.names() == ["claude", "gemini", "ollama", "openai"] and r.resolve("Anthropic", {}).shown == "claude:c"
    assert (r.explicit("ollama/x").provider, r.explicit("claude-z").provider, r.explicit("google/g").model_id, r.explicit(" ").model_id) == ("ollama", "claude", "g", "a")
    assert r.request("gemini", "x", {"INSIGHT_MODEL_GEMINI": "gemini/q"}).model_id == "q" and r.key_name("anthropic") == "ANTHROPIC_API_KEY"
    with pytest.raises(KeyError):
        r.resolve("none", {})
    r.register("Own", lambda env: r.explicit("x"))
    assert r.resolve("own", {}).model_id == "x" and r.key_name("own") is None


def test_job_with_a_model(spark):
    rows = [
        (0, "1", "A trial", "There were good results in all of the groups that were seen.", ["Journal Article"], []),
        (1, "2", "A letter", "There were good results in all of the groups that were seen.", ["Letter"], []),
        (2, "3", "No abstract", None, [], []),
        (3, "4", "Fails", "There were good results in all of the groups that were seen.", [], []),
        (4, "5", "Fenced", "There were good results in all of the groups that were seen.", [], []),
        (5, "6", "Broken", "There were good results in all of the groups that were seen.", [], []),
        (6, "7", "Quotes what isn't there", "Nothing of the kind was found in any of the groups seen.", [], []),
    ]
    good = json.dumps(answer())

    def model(prompt):
        if "Title: Fails" in prompt:
            raise RuntimeError("no connection")
        if "Title: Fenced" in prompt:
            return f"```json\n{good}\n```", 3, 4
        return ("not json" if "Title: Broken" in prompt else good), 3, 4

    records = spark.createDataFrame(rows, "idx long, pmid string, title string, abstract string, publication_types array<string>, keywords array<string>")
    quick = lambda r, p, m, attempts=3: insights_call(r, p, m, lambda s: None, attempts)
    insights_call = insights.call_model
    insights.call_model = quick
    try:
        out, fresh = insights.run(records, model, "openai:x")
        got = {r.pmid: r for r in out.collect()}
        assert {k: r.status for k, r in got.items()} == {"1": "auto_accepted", "2": "skipped_prefilter", "3": "validated_but_flagged", "4": "api_failure", "5": "auto_accepted", "6": "invalid_output", "7": "invalid_output"}
        assert got["4"].error == "no connection" and got["3"].acceptance_reasons == ["prefilter_minimal_unclear", "skipped_prefilter_no_abstract"] and got["1"].input_tokens == 3
        kept = spark.createDataFrame(fresh.select("k", "v").collect(), "k string, v string")
        assert kept.count() == 3

        def never(prompt):
            raise RuntimeError("asked")

        again = {r.pmid: r.status for r in insights.run(records, never, "openai:x", kept)[0].collect()}
        assert again["1"] == "auto_accepted" and again["6"] == "api_failure"
    finally:
        insights.call_model = insights_call


@pytest.mark.parametrize(
    ("spans", "labels", "codes"),
    [
        (["no significant difference was seen"], {"statistical_significance": "significant"}, ["sig_vs_evidence_neg"]),
        (["p < 0.05 but p > 0.05"], {}, ["mixed_significance_language"]),
        (["statistically significant"], {"statistical_significance": "not_significant"}, ["not_sig_vs_evidence_pos"]),
        (["p < 0.001"], {"statistical_significance": "not_significant"}, []),
        (["increased mortality"], {}, ["positive_vs_negative_language"]),
        (["good"], {"clinical_meaningfulness": "meaningful"}, ["meaningful_without_magnitude"]),
        (["hazard ratio 2"], {"clinical_meaningfulness": "meaningful"}, []),
    ],
)
def test_semantic_rules(spark, spans, labels, codes):
    a = answer()
    for f in extraction.FIELDS:
        a[f] = a[f] | {"evidence_spans": spans if f == "finding_direction" else [], "value": labels.get(f, a[f]["value"])}
    x = F.from_json(F.lit(json.dumps(a)), extraction.EXTRACTION)
    assert value(spark, rules.semantic_codes(x)) == codes


def test_grounding(spark):
    text = F.lit("Some  text\nof a record")
    block = lambda v, s: F.struct(F.lit(v).alias("value"), F.lit(0.5).alias("confidence"), F.array(*map(F.lit, s)).cast("array<string>").alias("evidence_spans"))
    assert value(spark, rules.missing_spans(block("positive", [" text of ", "", "absent"]), text)) == ["<empty span>", "absent"]
    assert value(spark, rules.missing_spans(block("positive", []), text)) == ["<no evidence span provided>"]
    assert value(spark, rules.missing_spans(block(" Unclear", ["", "absent"]), text)) == ["absent"]


def test_messages():
    assert messages.content([{"type": "text", "text": "a"}, "b", {"type": "x"}]) == "ab{'type': 'x'}" and messages.content(1) == "1"
    assert messages.usage({"input_tokens": 1, "output_tokens": 2}, {}) == (1, 2) and messages.usage(None, {"usage": {"prompt_tokens": 3}}) == (3, 0) and messages.usage({}, None) == (0, 0)
    a = messages.audit('{"supported": "false", "main_claim": " Weakly_Supported ", "notes": ["x", " ", 1]}')
    assert a["supported"] is True and a["main_claim"] == "weakly_supported" and a["finding_direction"] == "unsupported" and a["notes"] == ["x", "1"]
    assert messages.audit("[]") is None and messages.audit("no") is None and messages.audit('{"notes": "one"}')["notes"] == ["one"]


def test_audit_and_reports(spark, tmp_path):
    text = "There were good results in all of the groups that were seen."
    rows = [(i, str(i), f"T{i}", text, [], []) for i in range(4)]
    records = spark.createDataFrame(rows, "idx long, pmid string, title string, abstract string, publication_types array<string>, keywords array<string>")
    mixed = json.dumps(answer(finding_direction={"value": "mixed", "confidence": 0.9, "evidence_spans": ["good results"]}))

    plain = json.dumps(answer())

    def auditor(prompt):
        if "Title: T1" in prompt:
            raise RuntimeError("down")
        return ("?" if "Title: T2" in prompt else '{"supported": true}'), 5, 6

    out = insights.run(records, lambda p: (mixed if "Title: T3" not in p else plain, 1, 2), "m", audit_model=auditor)[0]
    got = {r.pmid: r for r in out.collect()}
    assert [got[str(i)].status for i in range(4)] == ["validated_but_flagged", "needs_human_review", "needs_human_review", "auto_accepted"]
    assert got["1"].audit.notes == ["audit_error:down"] and got["2"].audit.notes == ["audit_parse_failed"] and got["3"].audit is None and got["0"].input_tokens == 6
    lines = reports.insights_markdown(out, None, "v", "m", "o.json")
    assert "- `needs_human_review`: **2**" in lines and "1, 2" in lines and "- `mixed`: **3**" in lines and lines[-1] == "(none)"
    from quillspark.operators import duplicates

    dup = spark.createDataFrame([(0, "1", "x", None, 2000, "10.1/a", []), (1, "2", "y", None, 2000, "10.1/a", [])], "idx long, pmid string, title string, abstract string, publication_year int, doi string, publication_types array<string>")
    r = duplicates.report(dup)
    lines = list(reports.duplicates_markdown(r))
    assert "### Cluster 1 - `same_doi` (high)" in lines and "- 1↔2: same_doi" in lines and "| 2 |" in lines
    assert json.loads(reports.duplicates_json(r))["clusters"][0]["pmids"] == ["1", "2"]
    assert reports.insights_path("a.txt", True).name == "a.jsonl" and reports.insights_path(None, False).name == "insights.json"
    reports.write_text(lines, tmp_path / "d" / "r.md")
    assert (tmp_path / "d" / "r.md").read_text().startswith("# Probable")


def test_collection_in_lines(spark, tmp_path):
    """A collection was one row and one file, held whole by a task."""
    path = str(tmp_path / "lines")
    rows = spark.createDataFrame([(i, str(i), f'a "t"\n, "articles": [{i}', None if i % 2 else 1 + i % 12) for i in range(500)], "idx long, pmid string, title string, publication_month int").repartition(7)
    files.write_collection_lines(rows, {"query": "q", "total_match_count": 3}, path)
    parts = sorted((tmp_path / "lines").glob("part-*"))
    doc = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert doc["retrieved_count"] == 500 and [a["pmid"] for a in doc["articles"]] == [str(i) for i in range(500)]
    got, header = files.read_collection_lines(spark, path)
    assert [(r.idx, r.pmid, r.title, r.publication_month) for r in got.orderBy("idx").collect()] == [tuple(r) for r in rows.orderBy("idx").collect()]
    assert header.first()["query"] == "q" and header.first()["retrieved_count"] == 500 and header.count() == 1 and got.first().keywords == []
    files.write_collection_lines(rows.limit(0), {"query": "none"}, f"{path}0")
    empty, header = files.read_collection_lines(spark, f"{path}0")
    assert empty.count() == 0 and header.first()["retrieved_count"] == 0
