"""Schemas of records and collections."""

AUTHOR = "struct<last_name:string,fore_name:string,initials:string,affiliation:string>"
RECORD = (
    "struct<pmid:string,title:string,abstract:string,journal_full:string,journal_iso:string,publication_year:int,publication_month:int,publication_day:int,"
    f"doi:string,pmc_id:string,language:string,publication_types:array<string>,mesh_terms:array<string>,keywords:array<string>,authors:array<{AUTHOR}>>"
)
COLLECTION = f"query string, total_match_count int, requested_count int, retrieved_count int, articles array<{RECORD}>, warnings array<string>"
LISTS = ("publication_types", "mesh_terms", "keywords", "authors")
