"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next stage's ``docs``. All but the last return the columns of ``documents``, with
extra ones as they came, whatever their names; the last returns the packed pieces of what is left.

Defined results, stage by stage (n: nulls, e: empty texts, l: very long ones, t: ties, r: repeated rows; an empty
table gives an empty table everywhere):

* quality_rules: n and e have no words and go; l are measured whole; verdicts have no ties; r are judged alike.
* near_duplicates: n and e belong to no class and stay; l are compared whole; of a class the smallest doc_id
  stays (t: then the smallest hash of the text, null ids first); of r one stays.
* benchmark_decontamination: n and e have no words and stay; l are searched whole; all occurrences count,
  so there are no t; r are judged alike. Without benchmark items all stay.
* personal_data: n stay null, e stay empty; l are searched whole; of overlapping spans the first, then the longest
  gives its name (t); r are redacted alike.
* best_fit_packing: n and e are one piece with the end id; l are cut into whole sequences and a rest; which of
  equally full sequences takes a piece (t) doesn't change their number; r are packed each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm import decontaminate, jaccard_join, packing, pii, quality
from tarnweave.llm.common import materialize

#: The stages aren't expressible in SQL (chosen paths, expectation maximisation, tokenizer).
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: the one of smallest doc_id."""
    return jaccard_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a benchmark window, however long they are."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_hit=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
