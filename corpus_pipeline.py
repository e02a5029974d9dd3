"""A corpus preparation pipeline in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor
kept, and returns a DataFrame that is written as Parquet and read back as the next
one's docs.  The first four return the columns of documents:

1. quality classifier: documents whose perplexity under the model of all trusted texts is too high go;
2. quality rules: documents that fail the base rules or the adaptive thresholds go;
3. near-duplicates: one document of each class stays;
4. secret scan: secrets are blanked out of the texts;
5. packing: pieces of token sequences.

Only the columns of documents are carried; further ones, whatever their names, are left
behind at the first stage.  Nulls: a document without text is kept by the classifier and
fails the rules' least number of words; rows without id, language or source are treated
like others, and rows that share an id, or have none, are told apart by their texts.
Repeated rows are one group of near-duplicates, of which one stays.  Long texts are read
whole.  An empty table passes through all stages and gives no pieces.
"""

from __future__ import annotations

import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path[:0] = [p for p in [str(Path(__file__).resolve().parent)] if p not in sys.path]

from gridmill.checkpoints import remove  # noqa: E402
from gridmill.deploy import ship  # noqa: E402
from gridmill.llm import near_duplicates, packing, quality_kneser_ney, quality_rules, secrets  # noqa: E402
from gridmill.llm.queries import tokenizer_path  # noqa: E402
from gridmill.llm.shared import ensure_checkpoint_dir  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_kneser_ney.classify(docs.select(*COLUMNS), labels, keep=COLUMNS, crossed=True)
    return scored.filter("kept").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_secrets(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", blank_secrets),
    ("packing", pack),
]

#: SQL cannot express the perplexity model, the near-duplicate classes or the packing; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; stages in between are written to the shared checkpoint folder, each until the next one is there."""
    ensure_checkpoint_dir(ship(spark))
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
