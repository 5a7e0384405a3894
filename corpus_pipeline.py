"""A training corpus out of the documents table, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and
is the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, decontaminate, linedup, quality, simhash
from lamina.llm.common import discard, materialize, scratch
from lamina.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.7 or more).  A null
    or empty text is judged as one empty line; repeated rows stay or go together; without
    usable labels every score is 0.5, so all go.  An empty table gives no rows."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, model, name="", least=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier document has; a document of
    which nothing is left goes.  n_chars follows the text.  Null and empty texts have no
    lines and stay; rows equal in id and text are one document.  An empty table gives no
    rows."""
    names = docs.columns
    inner = [f"__d{i}" for i in range(len(names))]  # so that no column's name can clash
    text = inner[names.index("text")]
    out = linedup.remove_repeated_lines(docs.toDF(*inner), inner[names.index("doc_id")], text)
    out = out.where((F.col("__cut") == 0) | (F.length(F.trim(F.regexp_replace(text, r"\s+", ""))) > 0))
    if "n_chars" in names:
        size = inner[names.index("n_chars")]
        out = out.withColumn(size, F.when(F.col("__cut") > 0, F.char_length(text).cast(out.schema[size].dataType)).otherwise(F.col(size)))
    return out.select(*inner).toDF(*names)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id (rows without an id
    last; of rows equal in id and text one).  Null and empty texts are one group.  An empty
    table gives no rows."""
    return simhash.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs.  Null and empty texts stay;
    repeated rows stay or go together.  An empty table gives no rows, an empty benchmark
    drops none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and the ids themselves, of each row.
    Null and empty texts have no ids; other columns are not kept.  An empty table gives no
    rows."""
    return bpe.encode_table(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode),
]
#: No SQL can express the classifier, the alignment or the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table of the shared folder; what a stage
    and the one before it wrote is deleted when its own table is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            after = materialize(stage(spark, docs, sf_dir), f"stage{k}")
            kept.append(after)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
