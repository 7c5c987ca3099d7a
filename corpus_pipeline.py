"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, whatever they are named. Stages are written as Parquet between
one another. Empty tables pass through; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import cut, fresh_name, without
from siftline.llm.exact_dedup import exact_dedup
from siftline.llm.jaccard_join import jaccard_components
from siftline.llm.packing import pack
from siftline.llm.queries import table, tokenizer_path
from siftline.llm.secret_scan import redact, with_spans
from siftline.llm.toxicity import ToxicityModel, training_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go, by their texts alone: null and empty texts stay,
    equal texts share their fate. Without labels the model has no lexicon."""
    model = ToxicityModel(training_rows(docs, table(spark, sf_dir, "labels")))
    predicted = fresh_name(docs, "predicted")
    return model.scored(docs, fresh_name(docs, "score"), predicted).where(F.col(predicted) == 0).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null and empty texts are equal.
    Of rows that repeat both doc_id and text one stays, whatever their other columns hold."""
    marks = cut(exact_dedup(docs), "marks")
    removed = marks.where("not kept and not doc_id <=> keep_id").select("doc_id", "text_sha256")
    repeated = marks.where("not kept and doc_id <=> keep_id").select("doc_id", "text_sha256").distinct()
    left = without(docs, removed)
    if repeated.isEmpty():
        return left
    sha, key, text = (fresh_name(docs, n) for n in ("_sha", "_id", "_same_text"))
    rows = left.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    again = rows.join(repeated.toDF(key, text), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(text)), "left_semi")
    return without(left, repeated).unionByName(again.dropDuplicates(["doc_id", sha]).drop(sha))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Rows with
    a null doc_id and texts without words stay. Where rows repeat a doc_id, each row links
    by its own text, and rows of one doc_id count in order of their texts' digests."""
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = cut(jaccard_components(docs), "near")
        return without(docs, groups.where("component_id <> doc_id").select("doc_id"))
    row = fresh_name(docs, "_row")
    # numbers in the order of doc_id, written so that they stay what they are
    known = cut(known.orderBy("doc_id", F.sha2("text", 256)).withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = cut(jaccard_components(known.select(F.col(row).alias("doc_id"), "text")), "near")
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(row))
    return known.join(gone, row, "left_anti").select(docs.columns).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are masked, and n_chars, where there is one,
    counts the text as it is then. Texts without secrets, null ones too, stay as they are."""
    spans = fresh_name(docs, "found")
    rows = with_spans(docs, base=fresh_name(docs, "base"), found=spans)
    hit = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(hit, redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences. Executors still hold what
    the stages before took, so the workers' tables are far smaller than by default."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), chunks=50_000)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: a learned score is no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
