"""SQL (DuckDB) of the catalogue's queries. Not in SQL: fuzzy links and what rests on them, JSON repair."""

from __future__ import annotations

from quillspark.functions.rules import DIR_NEG, LABELS, MAGNITUDE, MESSAGES, SIG_NEG, SIG_POS, SKIP_TYPES
from quillspark.functions.text import PROMPT_VERSION
from quillspark.operators.duplicates import LABELS as LINKS
from quillspark.operators.duplicates import MIXED, REASONS
from quillspark.plans.adapters import answers_sql, records_sql
from quillspark.plans.insights import prompt_parts

MODEL = "openai:example"
#: The accented letters of the documents, as base letter and combining mark.
ACCENTS = {"é": ("e", 769), "ó": ("o", 769), "í": ("i", 769), "è": ("e", 768), "ñ": ("n", 771), "ü": ("u", 776), "ä": ("a", 776), "ö": ("o", 776), "ç": ("c", 807), "ê": ("e", 770)}


def _plain(x: str, mark: bool) -> str:
    out = f"lower({x})"
    for letter, (base, code) in ACCENTS.items():
        out = f"replace({out}, '{letter}', '{base}' || " + (f"chr({code})" if mark else "' '") + ")"
    return out


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _found(s: str, text: str) -> str:
    s = _strip(s)
    return f"({s} <> '' AND (contains({text}, {s}) OR contains({_collapse(text)}, {_collapse(s)})))"


_PLAIN_TITLE = _plain("title", False)
_TITLE = "coalesce(" + _collapse(rf"regexp_replace({_PLAIN_TITLE}, '[^a-z0-9_ß\s]', ' ', 'g')") + ", '')"
_DOI = r"nullif(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(doi)), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/)', ''), '^doi:', '')), '[.,;)]+$', ''), '')"
_T, _AB = _strip("title"), _strip("coalesce(abstract, '')")
_CANON = f"CASE WHEN {_T} <> '' AND {_AB} <> '' THEN {_T} || chr(10) || {_AB} WHEN {_T} <> '' THEN {_T} ELSE {_AB} END"
_EMBED = f"CASE WHEN {_T} <> '' AND {_AB} <> '' THEN {_T} || ' ' || {_AB} WHEN {_T} <> '' THEN {_T} WHEN {_AB} <> '' THEN {_AB} ELSE 'empty' END"

KEYED = f"""r AS ({records_sql()}),
k0 AS (SELECT *, {_DOI} AS ndoi, {_TITLE} AS ntitle, coalesce(left({_collapse(_plain('abstract', True))}, 8000), '') AS nabstract FROM r),
k1 AS (SELECT *, array_to_string(string_split(ntitle, ' ')[:4], ' ') AS prefix FROM k0),
k AS (SELECT *, CASE WHEN length(ntitle) >= 12 AND prefix <> '' THEN CASE WHEN publication_year IS NOT NULL THEN publication_year || '|' || prefix
        ELSE 'ny|' || prefix || '|b' || (length(ntitle) // 20) || '|' || left(ntitle, 40) END END AS bkey FROM k1)"""
STARS = "SELECT first_idx AS i, idx AS j FROM (SELECT idx, min(idx) OVER (PARTITION BY {by}) AS first_idx FROM k WHERE {where}) WHERE first_idx <> idx"
DOI_STARS = STARS.format(by="ndoi", where="ndoi IS NOT NULL")
TITLE_STARS = STARS.format(by="ntitle, publication_year", where="ntitle <> '' AND publication_year IS NOT NULL")


def _missing(value: str, span: str | None, text: str) -> str:
    """A field's missing spans joined, for one span at most."""
    unclear = f"lower({_strip(value)}) = 'unclear'"
    if span is None:
        return f"CASE WHEN {unclear} THEN '' ELSE '<no evidence span provided>' END"
    return f"CASE WHEN {_found(span, text)} THEN '' WHEN {_strip(span)} = '' THEN CASE WHEN {unclear} THEN '' ELSE '<empty span>' END ELSE {span} END"


_LISTED = "[" + ", ".join(f"''{a}''" for a in LABELS["finding_direction"]) + "]"
_SKIPPED = "CASE " + " ".join(f"WHEN contains(lower(string_split(types, '|')[{i}]), '{k}') THEN '{k}'" for i in (1, 2) for k in SKIP_TYPES) + " END"
ROUTED = f"""CASE WHEN {_AB} = '' OR length({_AB}) < 40 THEN 'minimal_unclear' WHEN ({_SKIPPED}) IS NOT NULL THEN 'skip' ELSE 'pass' END AS action,
  CASE WHEN {_AB} = '' THEN 'skipped_prefilter_no_abstract' WHEN length({_AB}) < 40 THEN 'skipped_prefilter_short_abstract'
       WHEN ({_SKIPPED}) IS NOT NULL THEN 'skipped_prefilter_non_primary_research:' || ({_SKIPPED}) END AS reason"""

_EV = "lower(concat_ws(' ', quote, CASE WHEN idx % 6 <> 0 THEN quote END, title, title))"
CHECKED = f"""a AS ({answers_sql()}),
b AS (SELECT *, {_CANON} AS hay, {_EV} AS ev, {ROUTED} FROM a),
c AS (SELECT *, {_missing('fd', 'quote', 'hay')} AS m1, CASE WHEN idx % 6 = 0 THEN {_missing('sg', None, 'hay')} ELSE {_missing('sg', 'quote', 'hay')} END AS m2,
        {_missing('cm', 'title', 'hay')} AS m3, {_missing('claim', 'title', 'hay')} AS m4,
        concat_ws('; ', CASE WHEN lower(fd) NOT IN ('mixed', 'negative', 'neutral', 'positive', 'unclear') THEN 'finding_direction must be one of {_LISTED}, got ''' || lower(fd) || '''' END) AS errors,
        regexp_matches(ev, '{SIG_NEG}') AS neg, regexp_matches(regexp_replace(ev, '{SIG_NEG}', ' ', 'g'), '{SIG_POS}') AS pos FROM b),
d AS (SELECT *, CASE WHEN neg AND pos THEN 'mixed_significance_language' WHEN sg = 'significant' AND neg THEN 'sig_vs_evidence_neg' WHEN sg = 'not_significant' AND pos THEN 'not_sig_vs_evidence_pos' END AS f1,
        CASE WHEN lower(fd) = 'positive' AND (regexp_matches(ev, '{DIR_NEG}') OR regexp_matches(lower(claim), '{DIR_NEG}')) THEN 'positive_vs_negative_language' END AS f2,
        CASE WHEN cm = 'meaningful' AND NOT regexp_matches(ev, '{MAGNITUDE}') THEN 'meaningful_without_magnitude' END AS f3,
        (m1 = '' AND m2 = '' AND m3 = '' AND m4 = '') AS grounded, length(hay) > 12000 AS long, (lower(fd) = 'mixed' OR cm = 'meaningful') AS notable FROM c),
e AS (SELECT *, (f1 IS NOT NULL OR f2 IS NOT NULL OR f3 IS NOT NULL) AS flagged, (idx % 17 <> 0 OR idx % 13 = 0) AS parses, (idx % 19 = 0 AND idx % 13 <> 0 AND idx % 17 <> 0) AS silent FROM d),
f AS (SELECT *, errors <> '' OR NOT grounded OR long OR flagged OR notable AS review,
        CASE WHEN notable OR flagged THEN idx % 3 <> 0 ELSE TRUE END AS audited FROM e),
g AS (SELECT *, action = 'pass' AND parses AND NOT silent AS valid,
        CASE WHEN action = 'skip' THEN 'skipped_prefilter' WHEN action = 'minimal_unclear' THEN 'validated_but_flagged' WHEN silent THEN 'api_failure' WHEN NOT parses THEN 'invalid_output'
          WHEN NOT grounded THEN 'invalid_output' WHEN errors = '' AND audited AND NOT review THEN 'auto_accepted' WHEN errors = '' AND audited THEN 'validated_but_flagged' ELSE 'needs_human_review' END AS status FROM f)"""

_FLAGS = " UNION ALL ".join(f"SELECT idx, {col} AS code FROM d WHERE {col} IS NOT NULL" for col in ("f1", "f2", "f3"))
_SEVERITY = " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _) in MESSAGES.items())
_MESSAGE = " ".join(f"WHEN '{k}' THEN '{m}'" for k, (_, m) in MESSAGES.items())
_PAIRS = """g AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, CAST(arg_max(quality, doc_id) AS VARCHAR) AS gold FROM labels GROUP BY 1),
p AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN contains(text, '###') OR contains(text, ' | ') OR contains(text, '!!') THEN '0' ELSE '1' END AS predicted FROM documents),
m AS (SELECT pmid, gold, predicted FROM g JOIN p USING (pmid))"""
_KNN = """n AS (SELECT q.vec_id AS i, x.vec_id AS j, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings x WHERE q.vec_id % 50 = 0),
t AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS rank FROM n QUALIFY rank <= 32)"""
_GROUNDS = (("finding_direction", "m1"), ("statistical_significance", "m2"), ("clinical_meaningfulness", "m3"), ("main_claim", "m4"))
_PART = "CASE WHEN text <> '' THEN concat_ws(': ', role, text) END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BEFORE = [_quoted(p) for p in prompt_parts()]
_PROMPT = " || ".join(x for pair in zip(_BEFORE, ("pmid", "coalesce(title, '')", "coalesce(abstract, '')", "replace(types, '|', ', ')", "'(none)'"), strict=False) for x in pair) + " || " + _BEFORE[-1]
_WHICH = "CASE WHEN n_kinds > 1 THEN {mixed} WHEN kind = 'same_doi' THEN {same_doi} ELSE {same_title_year} END"
_REASON, _DETAIL = (_WHICH.format(**{k: _quoted(REASONS[k][n]) for k in ("mixed", "same_doi", "same_title_year")}) for n in (0, 1))
_RECORD_TEXT = "nullif(trim(title, ' ' || chr(9) || chr(10)), '')"
_ABSTRACT_TEXT = f"CASE WHEN {_AB} <> '' THEN CASE WHEN idx % 3 = 0 THEN 'RESULTS: ' ELSE '' END || {_AB} WHEN abstract IS NOT NULL THEN CASE WHEN idx % 3 = 0 THEN 'RESULTS:' ELSE '' END END"

SQL = {
    "prompts": f"WITH r AS ({records_sql()}), p AS (SELECT idx, {_PROMPT} AS prompt FROM r) SELECT idx, length(prompt) AS n_chars, sha256(prompt) AS sha256 FROM p",
    "stream_routing": f"WITH r AS ({records_sql()}) SELECT idx, pmid, {ROUTED}, sha256({_CANON}) AS input_hash FROM r",
    "key_clusters": f"""WITH RECURSIVE {KEYED}, s AS ({DOI_STARS} UNION {TITLE_STARS}), e AS (SELECT i, j FROM s UNION SELECT j, i FROM s),
        w AS (SELECT i AS idx, i AS root FROM e UNION SELECT e.j, w.root FROM w JOIN e ON e.i = w.idx), c AS (SELECT idx, min(root) AS root FROM w GROUP BY idx),
        m AS (SELECT c.root, k.* FROM c JOIN k USING (idx)),
        n AS (SELECT root, idx, 1 AS o, 'PMID ' || pmid || ': title mentions retraction (verify in PubMed)' AS note FROM m WHERE contains(lower(title), 'retract')
          UNION ALL SELECT root, idx, 2, 'PMID ' || pmid || ': publication type includes ''Retracted Publication'' (verify replacement)' FROM m WHERE contains(lower(types), 'retract')),
        n20 AS (SELECT root, string_agg(note, '; ' ORDER BY idx, o) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY idx, o) AS nth FROM n) WHERE nth <= 20 GROUP BY root),
        p AS (SELECT a.root, a.idx AS i, b.idx AS j, 1 AS o, 'same_doi' AS kind, a.pmid || '↔' || b.pmid || ': {LINKS["same_doi"]}' AS line FROM m a JOIN m b ON a.ndoi = b.ndoi AND a.idx < b.idx
          UNION ALL SELECT a.root, a.idx, b.idx, 2, 'same_title_year', a.pmid || '↔' || b.pmid || ': {LINKS["same_title_year"]}' FROM m a JOIN m b ON a.ntitle = b.ntitle AND a.ntitle <> '' AND a.publication_year = b.publication_year AND a.idx < b.idx),
        t AS (SELECT root, count(DISTINCT kind) AS n_kinds, min(kind) AS kind, string_agg(line, '; ' ORDER BY i, j, o) AS edge_evidence FROM p GROUP BY root),
        g AS (SELECT root, count(*) AS n, string_agg(pmid, ',' ORDER BY idx) AS pmids FROM m GROUP BY root)
        SELECT row_number() OVER (ORDER BY root) AS cluster_id, n, pmids, {_REASON} AS primary_reason, 'high' AS confidence, {_DETAIL} AS detail, edge_evidence, CASE WHEN n_kinds > 1 THEN {_quoted(MIXED)} END AS transitivity_note,
          coalesce(notes, '') AS reviewer_notes FROM g JOIN t USING (root) LEFT JOIN n20 USING (root)""",
    "xml_records": f"""WITH r AS ({records_sql()}), x AS (SELECT *, idx % 10 <> 9 AS fine FROM r)
        SELECT idx, CASE WHEN fine THEN pmid END AS pmid, CASE WHEN fine THEN {_RECORD_TEXT} END AS title, CASE WHEN fine THEN sha256({_ABSTRACT_TEXT}) END AS abstract_sha256, CASE WHEN fine THEN publication_year END AS publication_year,
          CASE WHEN fine THEN [1, 2, 3, 4, 5, NULL, NULL, 12, NULL, 7][idx % 10 + 1] END AS publication_month, CASE WHEN fine THEN coalesce(nullif(trim(doi), ''), 'first') END AS doi, CASE WHEN fine THEN 'P' || pmid END AS pmc_id, CASE WHEN fine THEN language END AS language,
          CASE WHEN fine THEN types END AS types, CASE WHEN fine THEN 'A / b' END AS mesh, CASE WHEN fine THEN 'k' END AS keywords, CASE WHEN NOT fine THEN 'skipped record (no id): no id' END AS warning FROM x""",
    "json_lines": f"WITH r AS ({records_sql()}) SELECT idx, pmid, title, sha256(abstract) AS abstract_sha256, publication_year, types FROM r",
    "collection_file": f"WITH r AS ({records_sql()}) SELECT row_number() OVER (ORDER BY idx) - 1 AS place, pmid, title, sha256(abstract) AS abstract_sha256, publication_year, doi, types, 0 AS n_keywords, 'all' AS query, (SELECT count(*)::INT FROM r) AS retrieved_count FROM r",
    "collected": """WITH n AS (SELECT count(*) AS total FROM documents), w AS (SELECT total, unnest(range(total - 3)) AS idx FROM n), i AS (SELECT total, idx, 1000 + 3 * idx AS id FROM w),
        f AS (SELECT *, id % 11 <> 0 AND id % 13 <> 0 AS fine FROM i)
        SELECT idx, CAST(id AS VARCHAR) AS pmid, 'Record ' || id AS title, (id % 12 + 1)::INT AS publication_month, total::INT AS total_match_count, (total - 3)::INT AS requested_count, (count(*) OVER ())::INT AS retrieved_count,
          'The search matches ' || total || ' records, more than the ' || (total - 3) || ' asked for; only the first ' || (total - 3) || ' are returned.' AS notice FROM f WHERE fine""",
    "row_counts": "WITH g AS (SELECT DISTINCT doc_id FROM labels), p AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g JOIN p USING (doc_id)) AS n_common",
    "ready_stages": f"WITH r AS ({records_sql()}) SELECT pmid, 'ready' AS stage FROM r",
    "normal_keys": f"WITH {KEYED} SELECT idx, ndoi, ntitle, prefix, bkey, sha256(nabstract) AS abstract_sha256, length(nabstract)::INT AS abstract_chars FROM k",
    "content_keys": f"""WITH r AS ({records_sql()}), c AS (SELECT idx, pmid, {_CANON} AS canon, {_EMBED} AS emb FROM r)
        SELECT idx, sha256(canon) AS input_hash, sha256(pmid || '|{PROMPT_VERSION}|{MODEL}|' || sha256(canon)) AS cache_key, sha256(emb) AS embedding_text_sha256, length(canon) > 12000 AS too_long FROM c""",
    "same_doi_pairs": f"WITH {KEYED} SELECT a.idx AS i, b.idx AS j, 'same_doi' AS kind FROM k a JOIN k b ON a.ndoi = b.ndoi AND a.idx < b.idx",
    "same_title_year_groups": f"WITH {KEYED} SELECT ntitle, publication_year, count(*) AS n, min(idx) AS first_idx FROM k WHERE ntitle <> '' AND publication_year IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "same_title_year_stars": f"WITH {KEYED} {TITLE_STARS}",
    "block_sizes": f"WITH {KEYED} SELECT bkey, count(*) AS n FROM k WHERE bkey IS NOT NULL GROUP BY 1",
    "block_chunks": f"""WITH {KEYED}, n AS (SELECT idx, bkey, count(*) OVER (PARTITION BY bkey) AS held, row_number() OVER (PARTITION BY bkey ORDER BY length(ntitle), idx) AS a, row_number() OVER (PARTITION BY bkey ORDER BY idx) AS b FROM k WHERE bkey IS NOT NULL)
        SELECT idx, bkey, CASE WHEN held > 280 THEN (a - 1) // 140 ELSE 0 END AS chunk, CASE WHEN held > 280 THEN (a - 1) % 140 ELSE b - 1 END AS pos FROM n""",
    "key_components": f"""WITH RECURSIVE {KEYED}, s AS ({DOI_STARS} UNION {TITLE_STARS}), e AS (SELECT i, j FROM s UNION SELECT j, i FROM s),
        w AS (SELECT i AS idx, i AS root FROM e UNION SELECT e.j, w.root FROM w JOIN e ON e.i = w.idx) SELECT idx, min(root) AS root FROM w GROUP BY idx""",
    "retraction_notes": f"""WITH r AS ({records_sql()}), n AS (SELECT idx, concat_ws('; ', CASE WHEN contains(lower(title), 'retract') THEN 'PMID ' || pmid || ': title mentions retraction (verify in PubMed)' END,
        CASE WHEN contains(lower(types), 'retract') THEN 'PMID ' || pmid || ': publication type includes ''Retracted Publication'' (verify replacement)' END) AS notes FROM r) SELECT idx, notes FROM n WHERE notes <> ''""",
    "knn_cosine": f"WITH {_KNN} SELECT i, j, round(s, 9) AS similarity, rank FROM t",
    "knn_pairs": f"WITH {_KNN} SELECT DISTINCT i, j, round(s, 9) AS similarity FROM t WHERE j > i AND s >= 0.35",
    "routing": f"WITH r AS ({records_sql()}) SELECT idx, {ROUTED} FROM r",
    "label_errors": f"WITH {CHECKED} SELECT idx, errors FROM d",
    "span_grounding": f"WITH {CHECKED} " + " UNION ALL ".join(f"SELECT idx, '{n}' AS field_name, {m} = '' AS all_spans_found, {m} AS missing FROM d" for n, m in _GROUNDS),
    "semantic_flags": f"WITH {CHECKED}, z AS ({_FLAGS}) SELECT idx, code, CASE code {_SEVERITY} END AS severity, CASE code {_MESSAGE} END AS message FROM z",
    "final_status": f"""WITH {CHECKED} SELECT idx, status, CASE WHEN action = 'minimal_unclear' THEN 'needs_human_review' WHEN valid THEN CASE WHEN review THEN 'needs_human_review' ELSE 'auto_accept' END END AS auto_accept,
        CASE WHEN action = 'minimal_unclear' THEN 'prefilter_minimal_unclear,' || reason WHEN valid THEN concat_ws(',', CASE WHEN errors <> '' THEN 'schema_validation_failed' END, CASE WHEN NOT grounded THEN 'grounding_failed' END,
          CASE WHEN flagged THEN 'semantic_flags_present' END, CASE WHEN confidence < 0.5 THEN 'low_confidence_triage' END, CASE WHEN notable THEN 'audit_recommended' END, CASE WHEN NOT review THEN 'auto_accept_eligible' END) END AS reasons,
        valid AND long AS truncated FROM g""",
    "status_counts": f"WITH {CHECKED} SELECT status, count(*) AS n FROM g GROUP BY 1",
    "finding_counts": f"WITH {CHECKED} SELECT fd AS finding_direction, count(*) AS n FROM g WHERE valid GROUP BY 1",
    "review_lists": f"""WITH {CHECKED}, h AS (SELECT status, pmid, idx, row_number() OVER (PARTITION BY status ORDER BY idx) AS nth FROM g)
        SELECT s.status, coalesce(string_agg(pmid, ', ' ORDER BY idx), '(none)') AS pmids FROM (VALUES ('needs_human_review'), ('invalid_output'), ('api_failure')) s(status) LEFT JOIN h ON h.status = s.status AND nth <= 100 GROUP BY 1""",
    "job_totals": f"""WITH {CHECKED} SELECT count(*) FILTER (status = 'auto_accepted') AS auto_accepted, count(*) FILTER (status = 'validated_but_flagged') AS validated_but_flagged, count(*) FILTER (status = 'needs_human_review') AS needs_review,
        count(*) FILTER (status = 'invalid_output') AS invalid_output, count(*) FILTER (status = 'api_failure') AS api_failures, count(*) FILTER (status = 'skipped_prefilter') AS skipped_prefilter,
        count(*) FILTER (valid AND long) AS truncation_warning, count(*) AS input_tokens, 2 * count(*) AS output_tokens FROM g""",
    "audit_verdicts": f"WITH r AS ({records_sql()}) SELECT idx, CASE idx % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'weakly_supported' ELSE 'unsupported' END AS verdict FROM r",
    "gold_and_predicted": f"WITH {_PAIRS} SELECT pmid, gold, predicted FROM m",
    "classification_report": f"""WITH {_PAIRS}, l AS (SELECT gold AS label FROM m UNION SELECT predicted FROM m),
        c AS (SELECT label, (SELECT count(*) FROM m WHERE gold = label) AS support, (SELECT count(*) FROM m WHERE predicted = label) AS guessed, (SELECT count(*) FROM m WHERE gold = label AND predicted = label) AS hit FROM l),
        s AS (SELECT label, support, hit, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall FROM c),
        f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s),
        u AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
        SELECT label, round(precision::DOUBLE, 9) AS precision, round(recall::DOUBLE, 9) AS recall, round(f1::DOUBLE, 9) AS f1, support::BIGINT AS support FROM u""",
    "requested_rows": "SELECT CAST(d.doc_id AS VARCHAR) AS pmid, d.doc_id AS pos, l.quality, l.toxic FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id",
    "missing_rows": """WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS nth FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT count(*) AS n_missing, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) FILTER (nth <= 20) || CASE WHEN count(*) > 20 THEN ' (+' || (count(*) - 20) || ' more)' ELSE '' END AS preview FROM m""",
    "cache_upsert": f"WITH r AS ({records_sql()}) SELECT pmid AS k, CASE WHEN idx % 3 = 0 THEN 'new ' || pmid ELSE title END AS v FROM r WHERE idx % 3 = 0 OR idx % 2 = 0",
    "cache_lookup": f"WITH r AS ({records_sql()}) SELECT idx, idx % 4 = 0 AS hit, CASE WHEN idx % 4 = 0 THEN 'answer ' || idx END AS cached FROM r",
    "page_fields": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
        array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS links FROM pages""",
    "conversation_texts": f"SELECT conv_id, sha256(coalesce(string_agg({_PART}, chr(10) || chr(10) ORDER BY turn, {_PART}), '')) AS text_sha256, count(*) AS n_turns FROM conversations GROUP BY 1",
    "benchmark_spans": f"SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({_collapse('d.text')}, {_collapse('b.text')}) AND {_collapse('b.text')} <> ''",
    "record_order": "WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS pmid FROM customer) SELECT pmid, row_number() OVER (ORDER BY c_custkey % 5 = 0, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey ELSE 0 END, pmid) AS place FROM i",
}
