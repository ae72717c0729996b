"""Five corpus operators in a row over documents: what each keeps is written and is the next one's input.

toxicity drops documents that the noisy-or model rejects, line_dedup cuts later copies of three-line
windows, near_duplicates keeps one document of each component of the n-gram Jaccard join,
decontamination drops documents contaminated by the benchmark, and packing packs the rest into
sequences. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanline.llm import op1_decontamination, op2_lines, op5_packing, op9_toxicity, op10_jaccard
from gleanline.llm.common import documents, scratch

STAGES = [
    ("toxicity", op9_toxicity.stage),
    ("line_dedup", op2_lines.stage),
    ("near_duplicates", op10_jaccard.stage),
    ("decontamination", op1_decontamination.stage),
    ("packing", op5_packing.stage),
]

#: A trained model decides in the first stage and a tokenizer in the last: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents; each stage's result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
