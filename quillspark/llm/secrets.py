"""Secret scans: a trigram inverted index picks each rule's candidate documents, regular expressions verify them.

All of it is DataFrame operations. From each rule's pattern a Boolean trigram query is derived (trigrams.py). The index has, for
each trigram that some rule asks for, its posting list of documents, in blocks of documents of bounded size. Posting lists are
intersected and united block by block; what is left are candidates. Rules without mandatory trigrams scan every document. Only keys
move: candidates are a written table, broadcast where they are counted to be few; beyond that texts are joined by key.

No pattern can read a stretch of text more than a fixed number of times: none has a repeated group, and a rule whose parts may begin
anywhere in a run of characters takes the run as a whole and tests that (`inside`). Lists of matches are folded in chunks, so a text
with very many of them costs little more than their number.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows give repeated results; texts are scanned
whole; offsets count code points; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import few_rows, spool, table
from quillspark.llm.trigrams import trigram_query

#: About so many documents in a block of the index.
BLOCK_DOCS = 4096
#: Matches that are folded at once.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java, RE2 and Python share. A match counts if its group has `least` characters or more and, where
    `inside` is given, that pattern is found in the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    inside: str = ""

    @property
    def telling(self) -> str:
        """The pattern that trigrams are derived from."""
        return self.inside or self.pattern


BASE_RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("hosting", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("signed", "[A-Za-z0-9_.-]+", 0, 1, "(^|\\.)eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]"),
    Rule("private", "-----BEGIN [A-Z ]*-----", 0, 1, "BEGIN ([A-Z ]* )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _literal(s: str) -> Column:
    return F.lit(s)


def candidates(rows: DataFrame, rules: tuple[Rule, ...], n_docs: int, key: str = "key", text: str = "text") -> DataFrame:
    """(key, rules array<string>): kinds of the rules whose trigram query the document meets; rules without one are left out."""
    asked = {r.kind: trigram_query(r.telling) for r in rules}
    asked = {kind: q for kind, q in asked.items() if q}
    grams = sorted({g for q in asked.values() for clause in q for alt in clause for g in alt})
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), _literal(g)), F.lit(i)) for i, g in enumerate(grams))))
    postings = rows.select(key, low.alias("low")).select(key, F.explode(found).alias("gram"))
    block = F.pmod(F.xxhash64(key), F.lit(n_docs // BLOCK_DOCS + 1)).alias("block")
    lists = postings.groupBy(block).agg(*(F.collect_set(F.when(F.col("gram") == i, F.col(key))).alias(f"g{i}") for i in range(len(grams))))
    at = {g: F.col(f"g{i}") for i, g in enumerate(grams)}

    def alternative(alt: frozenset[str]) -> Column:
        return reduce(F.array_intersect, (at[g] for g in sorted(alt)))

    def query(clauses) -> Column:
        return reduce(F.array_intersect, (reduce(F.array_union, (alternative(a) for a in sorted(c, key=sorted))) for c in clauses))

    hits = F.array(*(F.struct(F.lit(kind).alias("kind"), query(q).alias("keys")) for kind, q in asked.items()))
    return lists.select(F.explode(hits).alias("h")).select(F.col("h.kind").alias("kind"), F.explode("h.keys").alias(key)).groupBy(key).agg(F.collect_set("kind").alias("rules"))


def _once(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, CHUNK))
    return _once(items, cut)


def _folded(items: Column, kind: str, start: Column, step) -> Column:
    """array<kind> of what step puts out over the items, in order: step(at, item) gives (next at, what it puts out or null). Chunks are
    folded one by one, so that no list grows by copies of itself."""
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, item: Column) -> Column:
        at, out = step(acc["at"], item)
        return F.struct(at.alias("at"), F.when(out.isNotNull(), F.array_append(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return _once(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    first = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(_chunks(items), first, outer, lambda acc: F.flatten(acc["out"]))


def spans_of(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of a rule's matches: offsets are summed from the lengths of matches and of what lies between."""
    pattern = _literal(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)

    def counts(v: Column) -> Column:
        long = F.length(v) >= rule.least
        return long & v.rlike(rule.inside) if rule.inside else long

    steps = F.zip_with(
        F.zip_with(F.transform(between, F.length), F.transform(whole, F.length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size"))),
        F.transform(value, counts),
        lambda s, kept: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), kept.alias("kept")),
    )
    steps = F.filter(steps, lambda s: s["size"].isNotNull())

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        begin, end = at + s["gap"], at + s["gap"] + s["size"]
        return end, F.when(s["kept"], F.struct(begin.alias("start"), end.alias("end")))

    return _folded(steps, "struct<start:int,end:int>", F.lit(0), step)


def _exhaustive(rule: Rule) -> Rule:
    """A pattern that is one repeated class is searched with its least length at once: its matches are maximal runs either way."""
    if not rule.inside and rule.pattern.startswith("[") and rule.pattern.index("]") == len(rule.pattern) - 2 and rule.pattern.endswith("+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, spans array<struct<start, ord, end, kind>> in order of start and rule, and the columns in keep), a row for each of docs."""
    extra = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)
    rows = rows.withColumn("key", F.coalesce(F.col("id"), F.xxhash64("text")))
    asked = {r.kind for r in rules if trigram_query(r.telling)}
    if asked:
        rows = rows.join(few_rows(spool(candidates(rows, rules, docs.count()), "candidates")), "key", "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def tagged(i: int, rule: Rule) -> Column:
        rule = _exhaustive(rule)
        wanted = F.array_contains("rules", rule.kind) if rule.kind in asked else F.col("text").rlike(rule.pattern)
        spans = F.when(wanted, spans_of(rule, F.col("text"))).otherwise(empty)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    spans = F.sort_array(F.concat(*(tagged(i, r) for i, r in enumerate(rules))))
    return rows.select(F.col("id").alias(id_col), "text", spans.alias("spans"), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with one mark for each run of overlapping spans, which must be in order of their starts."""
    def inner(part: Column, base: Column):
        def step(acc: Column, s: Column) -> Column:
            begin = s["start"] - base
            fresh = begin >= acc["at"]
            out = F.when(fresh, F.concat(acc["out"], F.substring(part, acc["at"] + 1, begin - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"] - base).alias("at"), out.alias("out"))

        return step

    def outer(acc: Column, chunk: Column) -> Column:  # chunk by chunk, on the part of the text that its spans reach
        end = F.greatest(acc["at"], F.coalesce(F.array_max(F.transform(chunk, lambda s: s["end"])), F.lit(0)))
        part = F.substring(text, acc["at"] + 1, end - acc["at"])
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        marked = F.transform(F.array(part), lambda p: F.aggregate(chunk, first, inner(p, acc["at"]), lambda r: r["out"]))
        return F.struct(end.alias("at"), F.concat(acc["out"], marked).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(_chunks(spans), start, outer, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    return found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op7_sql() -> str:
    def one(i: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return f"""SELECT n, {i} AS ord, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS v,
                   regexp_split_to_array(t, '{pattern}') AS gaps, {r.least} AS least, '{r.inside}' AS inside FROM d"""

    rules = " UNION ALL ".join(one(i, r) for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({rules}),
each AS (SELECT n, ord, kind, least, inside, v[i] AS value, length(v[i]) AS kept, length(m[i]) AS size,
                list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0) AS start
         FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0)),
spans AS (SELECT n, ord, kind, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM each WHERE kept >= least AND (inside = '' OR regexp_matches(value, inside))),
agg AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
               string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (n)"""
