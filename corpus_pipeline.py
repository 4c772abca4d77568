"""The corpus pipeline: five operators in a row over documents, each on all that its predecessor kept.

Toxic documents go; of similar lines one occurrence stays, and documents of which no word is left go; of each group of near
duplicates one document stays; sources are mixed to their target weights (documents occur as often as their copies); what
is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import toxicity
from cytolake.llm.linededup import dedup_lines
from cytolake.llm.mixing import mixed_documents, words_of
from cytolake.llm.neardup import near_duplicates
from cytolake.llm.packing import pack
from cytolake.llm.shared import Tables, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, keep=COLUMNS).where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs.select(COLUMNS)).where((F.col("n_dropped") == 0) | (words_of(F.col("text")) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five words and 0.8, as for every stage on shingles; a document's rows beyond its first are copies too
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    gone = Tables(spark).cut(gone, "gone")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No SQL: the stages train a model and iterate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read(spark, sf_dir, "documents"), Tables(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.cut(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            tables.drop(f"stage-{k - 1}")
    return docs
