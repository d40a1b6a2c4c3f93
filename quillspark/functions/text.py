"""Normal forms and keys of record fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() and \s of Python take for white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Fixed values.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
PREFIX_WORDS, LENGTH_BAND, HEAD_CHARS, ABSTRACT_CHARS, LEAST_TITLE = 4, 20, 40, 8000, 12
PROMPT_VERSION, VALIDATOR_VERSION = "2026.04.08.2", "2026.04.08.1"


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def decompose(c: Column) -> Column:
    """NFKD, by the ICU library that Spark itself brings. Texts of ASCII alone are as they are. (ICU may know letters of a newer Unicode
    than Python's unicodedata; for all that both know they agree.)"""
    nfkd = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7f]"), nfkd).otherwise(c)


def doi(c: Column) -> Column:
    """Lower case, without resolver prefixes (each tried once, in order) and closing punctuation; null if nothing is left."""
    out = F.lower(strip(c))
    for p in DOI_PREFIXES:
        out = F.when(out.startswith(p), F.substr(out, F.lit(len(p) + 1))).otherwise(out)
    return F.nullif(F.regexp_replace(strip(out), r"[.,;)]+$", ""), F.lit(""))


def title(c: Column) -> Column:
    """Decomposed, lower case, everything but letters, digits, _ and white space blank, white space collapsed; "" for null."""
    return F.coalesce(collapse(F.regexp_replace(F.lower(decompose(c)), r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " ")), F.lit(""))


def title_prefix(normal_title: Column) -> Column:
    return F.array_join(F.slice(F.split(normal_title, " "), 1, PREFIX_WORDS), " ")


def block_key(normal_title: Column, year: Column) -> Column:
    """Year and title prefix; without a year the prefix, a band of title lengths and the title's head."""
    prefix = title_prefix(normal_title)
    band = F.concat(F.lit("b"), F.floor(F.length(normal_title) / LENGTH_BAND).cast("string"))
    return F.when(year.isNotNull(), F.concat_ws("|", year.cast("string"), prefix)).otherwise(F.concat_ws("|", F.lit("ny"), prefix, band, F.left(normal_title, F.lit(HEAD_CHARS))))


def abstract(c: Column) -> Column:
    return F.coalesce(F.left(collapse(F.lower(decompose(c))), F.lit(ABSTRACT_CHARS)), F.lit(""))


def canonical(title_col: Column, abstract_col: Column) -> Column:
    """Title and abstract on two lines, or whichever there is."""
    t, a = (strip(F.coalesce(c, F.lit(""))) for c in (title_col, abstract_col))
    return F.when((t != "") & (a != ""), F.concat(t, F.lit("\n"), a)).when(t != "", t).otherwise(a)


def embedding_text(title_col: Column, abstract_col: Column) -> Column:
    t, a = (strip(F.coalesce(c, F.lit(""))) for c in (title_col, abstract_col))
    return F.when((t != "") & (a != ""), F.concat(t, F.lit(" "), a)).when(t != "", t).when(a != "", a).otherwise(F.lit("empty"))


def input_hash(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def cache_key(pmid: Column, model: str, hash_col: Column) -> Column:
    return F.sha2(F.concat_ws("|", pmid, F.lit(PROMPT_VERSION), F.lit(model), hash_col), 256)


def record_order(pmid: Column) -> Column:
    """Numbers first, by value, then other ids as text: a struct to sort by."""
    number = F.when(pmid.rlike("^[0-9]{1,38}$"), pmid.cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0).cast("decimal(38,0)")).alias("number"), pmid.alias("pmid"))


def retraction_notes(pmid: Column, title_col: Column, types: Column) -> Column:
    first = F.try_element_at(F.filter(types, lambda t: F.contains(F.lower(t), F.lit("retract"))), F.lit(1))
    return F.array_compact(F.array(
        F.when(F.contains(F.lower(title_col), F.lit("retract")), F.concat(F.lit("PMID "), pmid, F.lit(": title mentions retraction (verify in PubMed)"))),
        F.when(first.isNotNull(), F.concat(F.lit("PMID "), pmid, F.lit(": publication type includes '"), first, F.lit("' (verify replacement)"))),
    ))
