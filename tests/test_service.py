"""Collecting, embeddings, requests, folders, clients, progress."""

import datetime
import json
import types

import numpy as np
import pytest

from quillspark.operators import duplicates, embeddings, records
from quillspark.plans import service
from quillspark.plans.providers import Registry, Resolution
from quillspark.sources import article_xml, collect, files, paged

DEFAULTS = {"openai": "o", "gemini": "g", "claude": "c", "ollama": "l"}


def pages_of(ids, total=None):
    return lambda start, size: json.dumps({"esearchresult": {"count": str(len(ids) if total is None else total), "idlist": ids[start : start + size]}})


@pytest.mark.parametrize(("most", "total", "held"), [(25, 30, 30), (30, 30, 30), (50, 30, 30), (4, 30, 30), (25, 30, 17), (25, 30, 20), (25, 0, 0), (10, 30, 10), (25, 30, 3)])
def test_search_like_one_page_after_another(spark, monkeypatch, most, total, held):
    monkeypatch.setattr(paged, "PAGE", 10)
    ids = [str(100 + i) for i in range(held)]
    want = paged.search(pages_of(ids, total), most)
    n, got = collect.search(spark, f"s{most}_{total}_{held}", pages_of(ids, total), most, 10)
    assert (n, [r.pmid for r in got.orderBy("pos").collect()]) == want


def test_search_stops_at_a_page_without_ids(spark):
    ids = [str(i) for i in range(100)]
    full = pages_of(ids)
    hole = lambda start, size: full(start, size) if start != 20 else '{"esearchresult": {"count": "100", "idlist": []}}'
    got = collect.search(spark, "hole", hole, 60, 10)[1]
    assert [r.pmid for r in got.orderBy("pos").collect()] == ids[:20]
    with pytest.raises(ValueError):
        collect.search(spark, "none", pages_of(ids), 0)


def test_collect(spark):
    xml = lambda i: f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    fetch = lambda ids: "<S>" + "".join(map(xml, reversed([i for i in ids if i != "7"]))) + "<PubmedArticle><MedlineCitation/></PubmedArticle></S>"
    rows, header = collect.collect(spark, "q", 12, pages_of([str(i) for i in range(20)]), fetch, "small", 5)
    assert [(r.pmid, r.title) for r in rows.orderBy("idx").collect()] == [(str(i), f"T{i}") for i in range(12) if i != 7]
    assert header["total_match_count"] == 20 and header["retrieved_count"] == 11 and len(header["warnings"]) == 2 and "more than the 12" in header["notice"] and header["warnings"][1] == "1 records were not returned: 7"
    with pytest.raises(Exception, match="out of order"):
        collect.collect(spark, "q", 3, pages_of(["1"]), lambda ids: "<ERROR>out of order</ERROR>", "failing", 5)
    empty, header = collect.collect(spark, "q", 3, pages_of([]), fetch, "empty", 5)
    assert empty.count() == 0 and header["retrieved_count"] == 0


def test_settings_and_params(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# no\nA=1\nexport B='two words'\nC=3 # said\n\nbroken\nD=\n")
    assert collect.settings({"A": "own"}, path) == {"A": "own", "B": "two words", "C": "3", "D": ""} and collect.settings({"x": "y"}, tmp_path / "none") == {"x": "y"}
    assert collect.request_params("t", term="x") == {"db": "pubmed", "tool": "t", "term": "x"} and collect.request_params("t", "k", "e@x")["email"] == "e@x"
    assert collect.shared_rate(True, 5) == 2.0 and collect.cap_notice(5, 5) is None


@pytest.mark.parametrize(("said", "ids"), [("null", []), ('"7"', ["7"]), ("[1, \"2\"]", ["1", "2"]), ("7", ["7"])])
def test_shapes_of_id_lists(said, ids):
    assert paged.search_page('{"esearchresult": {"count": "3", "idlist": ' + said + "}}") == (3, ids)


@pytest.mark.parametrize(("given", "want"), [("Jan.", 1), ("Jan-Feb", 1), ("JULY", 7), ("03", 3), ("13", None), ("Spring", None), (" ", None), (None, None)])
def test_months(given, want):
    assert article_xml.month(given) == want


def test_elements_are_dropped_as_they_are_read():
    text = "<S>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID></MedlineCitation></PubmedArticle>" for i in range(500)) + "</S>"
    first = None
    for n, el in enumerate(article_xml.record_elements(text)):
        assert article_xml.fallback_id(el) == str(n)
        first = first if first is not None else el
    assert n == 499 and len(first) == 1


def test_embeddings(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}", None) for i in range(40)], "idx long, title string, abstract string")
    encode = lambda texts: np.array([[1.0, float(t[1] == "1"), 5.0 * float(t[1] == "2")] for t in texts])
    got = {r.idx: r.embedding for r in embeddings.embed(rows, encode).collect()}
    assert len(got) == 40 and np.allclose(got[1], [2**-0.5, 2**-0.5, 0], atol=1e-6)
    pairs = {(r.i, r.j) for r in embeddings.embedding_pairs(rows, encode, 0.99, 50).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 == j % 3}
    assert embeddings.optional_pairs(rows, lambda texts: np.zeros(3), True) is None and embeddings.optional_pairs(rows, None, True) is None and embeddings.optional_pairs(rows, encode, False) is None
    assert embeddings.optional_pairs(rows.limit(1), encode, True) is None and embeddings.optional_pairs(rows, encode, True).count() == len({p for p in pairs})
    assert embeddings.layer_wanted(None, {"X": "Yes"}, "X") and not embeddings.layer_wanted(None, {}, "X") and not embeddings.layer_wanted(False, {"X": "1"}, "X")


def test_links_with_embeddings(spark):
    rows = spark.createDataFrame([(i, str(i), f"a title of its own {i}", None, 2000 + i, None, []) for i in range(4)], "idx long, pmid string, title string, abstract string, publication_year int, doi string, publication_types array<string>")
    pairs = embeddings.optional_pairs(rows, lambda texts: np.array([[1.0, float(t.endswith(("0", "3")))] for t in texts]), True)
    r = duplicates.report(rows, pairs)
    assert r["stats"]["specter_pairs_added"] == 2 and sorted(c.pmids for c in r["clusters"].collect()) == [["0", "3"], ["1", "2"]]


def test_requests():
    for bad in ({"query": ""}, {"query": "q", "count": 0}, {"query": "q", "tool": ""}):
        with pytest.raises(service.RequestError):
            service.CollectRequest(**bad)
    for bad in ({"collection_path": ""}, {"collection_path": "x", "concurrency": 65}, {"collection_path": "x", "confidence_threshold": 1.5}, {"collection_path": "x", "progress_every": 0}):
        with pytest.raises(service.RequestError):
            service.InsightRequest(**bad)
    registry = Registry(DEFAULTS)
    assert service.CollectRequest("q").count == 100 and service.InsightRequest("x", llm=" Claude ").resolution(registry, {}).shown == "claude:c" and service.InsightRequest("x", model="gemini/m").resolution(registry, {}).shown == "gemini:m"
    assert service.wanted_query([" a", "b "]) == "a b" and service.wanted_provider("anthropic", registry, {}).model_id == "c"
    for call in (lambda: service.wanted_query([" "]), lambda: service.wanted_provider(None, registry, {}), lambda: service.wanted_provider("nobody", registry, {})):
        with pytest.raises(service.UsageError) as error:
            call()
        assert error.value.code == 2


def test_files_and_folders(tmp_path, monkeypatch, spark):
    done = service.write_results({"report": (tmp_path / "a" / "r.json", "{}")})
    assert done.paths == {"report": str(tmp_path / "a" / "r.json")} and done.output_format == "file"
    inner = tmp_path / "p" / "q"
    inner.mkdir(parents=True)
    (tmp_path / "p" / "pyproject.toml").touch()
    monkeypatch.chdir(tmp_path)
    assert service.project_root(inner / "m.py") == tmp_path / "p" and service.project_root(tmp_path / "x") == tmp_path
    assert service.run_folder(tmp_path, datetime.datetime(2024, 2, 3, 4, 5, 6)).name == "workflow_20240203_040506"
    rows = spark.createDataFrame([(1, "b", None), (0, "a", "é")], "idx long, pmid string, title string")
    files.write_collection(rows, {"query": "q", "retrieved_count": 2}, str(tmp_path / "c" / "out.json"))
    assert json.loads((tmp_path / "c" / "out.json").read_text()) == {"query": "q", "retrieved_count": 2, "articles": [{"pmid": "a", "title": "é"}, {"pmid": "b", "title": None}]}
    cache = f"file://{tmp_path}/cache"
    files.create_cache(spark, cache)
    files.create_cache(spark, cache)
    assert files.read_cache(spark, cache).count() == 0


def test_clients():
    made = []
    kind = lambda name: lambda **k: made.append((name, k)) or types.SimpleNamespace(bind=lambda **b: (name, b))
    load = lambda package: types.SimpleNamespace(**{service.CLIENTS[p][1]: kind(p) for p in service.CLIENTS if service.CLIENTS[p][0] == package})
    bound = [service.in_json_mode(service.chat_client(Resolution(p, "m", {}), load), p) for p in service.CLIENTS]
    assert [k for _, k in made][2:] == [{"model_name": "m", "temperature": 0.0}, {"model": "m", "temperature": 0.0, "base_url": "http://localhost:11434"}]
    assert bound[0] == ("openai", {"response_format": {"type": "json_object"}}) and bound[1][1] == {"response_mime_type": "application/json"} and not isinstance(bound[3], tuple)

    class Old:
        def bind(self, **options):
            raise TypeError

    old = Old()
    assert service.in_json_mode(old, "gemini") is old
    with pytest.raises(TypeError):
        service.in_json_mode(old, "openai")
    with pytest.raises(ValueError):
        service.chat_client(Resolution("nobody", "m", {}), load)


def test_progress_and_lines(spark):
    told = []
    p = service.Progress(7, 3, told.append)
    for _ in range(7):
        p.completed()
    assert told == [f"{n} of 7 records are done" for n in (3, 6, 7)]
    results = spark.createDataFrame([("auto_accepted", False, 3, 4), ("api_failure", True, 0, 0)], "status string, truncated boolean, input_tokens long, output_tokens long")
    totals = records.job_totals(results).first().asDict()
    assert service.stats_line(totals) == "Stats: auto_accepted=1 validated_flagged=0 needs_review=0 invalid=0 api_fail=1 skipped=0 trunc_warn=1 tokens_in=3 tokens_out=4"
    assert json.loads(service.insights_summary(totals, None, "v", "m"))["stats"]["input_tokens"] == 3


def test_tasks_of_a_collection_are_bounded(spark, monkeypatch):
    """Each page and each batch of ids was a task, and each task got all of them."""
    ids = [str(i) for i in range(2500)]
    source = collect.search_source("many", pages_of(ids))
    reader = source({"first": "0", "most": "100000", "page": "5"}).reader(None)
    assert len(reader.partitions()) <= collect.MOST_TASKS and sum(p.stop - p.start for p in reader.partitions()) == 100_000
    monkeypatch.setattr(collect, "MOST_TASKS", 3)
    xml = lambda i: f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID></MedlineCitation></PubmedArticle>"
    rows, header = collect.collect(spark, "q", 2400, pages_of(ids), lambda own: f"<S>{''.join(map(xml, own))}</S>", "many", 7)
    assert [r.pmid for r in rows.orderBy("idx").collect()] == ids[:2400] and header["retrieved_count"] == 2400
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos long, pmid string")
    answers = collect.fetched(frame, lambda own: str(len(own)), 3)
    assert answers.rdd.getNumPartitions() <= 3 and sorted((r.pos, r.xml) for r in answers.collect()) == [(200 * i, "200" if i < 12 else "100") for i in range(13)]
