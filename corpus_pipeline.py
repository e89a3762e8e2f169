"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.  Each
stage works on all rows its predecessor kept.  n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from cadenza.llm.graph import stored
from cadenza.llm.shared import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines above their host's limit."""
    return _documents(quality.quality_rules(docs).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; a document that loses all its lines stays, empty."""
    return _documents(line_dedup.dedup_lines(docs))


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return _documents(near_dedup.drop_near_duplicates(docs))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose their spans of benchmark windows."""
    found = decontaminate.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(decontaminate.cut_spans(found.where(~decontaminate.contaminated())))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their tokens, topic and probability."""
    return mixing.mix_sources(docs).where("sampled").select(*COLUMNS, "topic", "n_tokens", F.round("probability", 6).alias("probability"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, folder, name)
    return docs


_MIX, _MIXED = mixing.mixing_sql("s4")
ORACLE_SQL = f"""
WITH q AS MATERIALIZED ({quality.quality_sql()}),
s1 AS MATERIALIZED (SELECT doc_id, left_text AS text, lang, source FROM q JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) WHERE kept),
ld AS MATERIALIZED ({line_dedup.line_dedup_sql("s1")}),
s2 AS MATERIALIZED (SELECT doc_id, ld.text, lang, source FROM ld JOIN (SELECT doc_id, lang, source FROM s1) USING (doc_id)),
nd AS MATERIALIZED ({near_dedup.near_dedup_sql("s2")}),
s3 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN nd USING (doc_id) WHERE nd.kept),
dc AS MATERIALIZED (SELECT * FROM ({decontaminate.decontamination_sql("s3")}) WHERE NOT contaminated),
s4 AS MATERIALIZED (SELECT doc_id, c.text, lang, source, length(c.text) AS n_chars FROM ({decontaminate.cut_sql("dc")}) c JOIN (SELECT doc_id, lang, source FROM s3) USING (doc_id)),
{_MIX}
SELECT doc_id, text, lang, source, n_chars, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(probability, 6) AS probability FROM {_MIXED} WHERE sampled
"""
