"""Views of the driver's tables as records and as model answers, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: documents as records: the first line is the title, the rest the abstract; year, DOI and types follow from the source and the text.
RECORDS = """
SELECT doc_id AS idx, CAST(doc_id AS VARCHAR(20)) AS pmid,
       split_part(text, chr(10), 1) AS title,
       CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS abstract,
       CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN NULL ELSE 2010 + CAST(substr(source, 4) AS INT) % 3 END AS publication_year,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE
         CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'DOI: ' WHEN 2 THEN 'http://dx.doi.org/' ELSE '' END
         || '10.5555/' || upper(md5(text)) || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END END AS doi,
       CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 'Journal Article' WHEN 1 THEN 'Letter' WHEN 2 THEN 'Journal Article|Published Erratum'
         WHEN 3 THEN 'Retracted Publication' WHEN 4 THEN 'Review' ELSE 'Editorial|Comment' END AS types,
       lang AS language
FROM {documents} WHERE text IS NOT NULL"""

#: An answer for each record, right and wrong in ways that follow from its number; quotes are the title, or a phrase of a fixed list.
ANSWERS = """
SELECT idx, pmid, title, abstract, types,
       CASE idx % 7 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'unclear' WHEN 4 THEN 'neutral' WHEN 5 THEN 'sideways' ELSE 'positive' END AS fd,
       CASE idx % 4 WHEN 0 THEN 'significant' WHEN 1 THEN 'not_significant' WHEN 2 THEN 'unclear' ELSE 'significant' END AS sg,
       CASE idx % 5 WHEN 0 THEN 'meaningful' WHEN 1 THEN 'unclear' ELSE 'not_meaningful' END AS cm,
       CASE idx % 11 WHEN 0 THEN 'harm' ELSE 'a claim' END AS claim,
       CASE idx % 9 WHEN 0 THEN 'no significant difference' WHEN 1 THEN 'p < 0.05 and p > 0.05' WHEN 2 THEN 'significantly improved, hazard ratio 2' WHEN 3 THEN 'not in the text'
         WHEN 4 THEN '' ELSE title END AS quote,
       CAST((idx % 10) AS DOUBLE) / 10 AS confidence
FROM ({records}) r"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.sql(RECORDS, documents=table(spark, sf_dir, "documents"))
    return out.withColumn("idx", F.col("idx").cast("long")).withColumn("publication_types", F.split("types", "\\|"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with the fields of an answer."""
    return spark.sql(ANSWERS.replace("({records})", "{records}"), records=spark.sql(RECORDS, documents=table(spark, sf_dir, "documents"))).withColumn("publication_types", F.split("types", "\\|"))


def extraction(quote=None):
    """The answer's fields as an extraction struct."""
    q = F.col("quote") if quote is None else quote

    def block(value: str, spans):
        return F.struct(F.col(value).alias("value"), F.col("confidence").alias("confidence"), spans.alias("evidence_spans"), F.lit(None).cast("string").alias("reasoning_summary"))

    none = F.array().cast("array<string>")
    return F.struct(
        F.col("pmid").alias("pmid"), block("fd", F.array(q)).alias("finding_direction"), block("sg", F.when(F.col("idx") % 6 == 0, none).otherwise(F.array(q))).alias("statistical_significance"),
        block("cm", F.array(F.col("title"))).alias("clinical_meaningfulness"), block("claim", F.array(F.col("title"))).alias("main_claim"), none.alias("review_flags"),
    )


def records_sql() -> str:
    return RECORDS.format(documents="documents")


def answers_sql() -> str:
    return ANSWERS.format(records=records_sql())
