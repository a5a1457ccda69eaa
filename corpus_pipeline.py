"""A training corpus from raw documents: reject, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes
what a stage returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm.decontamination import contaminated
from subloom.llm.jaccard_join import near_duplicates
from subloom.llm.line_dedup import line_dedup
from subloom.llm.packing import pack_documents
from subloom.llm.queries import LIMIT, table, vocabulary
from subloom.llm.toxicity import fit_toxicity, score_toxicity
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize, write_through


# A column of our own while a stage runs: the rows of one id are told apart by their texts.
KEY, SCORE = "__key", "__score"


def keyed(docs: DataFrame) -> DataFrame:
    text = F.md5(F.coalesce("text", F.lit("")))
    return docs.withColumn(KEY, F.concat_ws(":", F.col("doc_id").cast("string"), text))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on these documents' labels, scores below
    0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, score_column=SCORE)
    return scored.filter(F.col(SCORE) < 0.5).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; n_chars is that of the new text.
    A document keeps its row when no line is left."""
    kept = line_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, rows that repeat an id or have none
    included. Documents without words are in no group and stay."""
    rows = keyed(docs)
    groups = write_through(near_duplicates(rows, id_column=KEY), "groups")
    copies = groups.filter(F.col(KEY) != F.col("component_id")).select(KEY).distinct()
    kept = rows.join(checked_broadcast(materialize(copies)), KEY, "left_anti")
    worded = groups.filter("n_shingles > 0").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    again = checked_broadcast(materialize(worded.filter("n > 1").select(KEY)))
    once = kept.join(again, KEY, "left_semi").dropDuplicates([KEY])
    return kept.join(again, KEY, "left_anti").unionByName(once).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = keyed(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_column=KEY)
    dirty = materialize(found.select(KEY).distinct())
    return rows.join(checked_broadcast(dirty), KEY, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return pack_documents(docs, vocabulary(), LIMIT)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Learnt classifiers and tokenizers have no SQL; tests/llm/test_pipeline.py compares run() with a
# plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
