"""From documents to token ids: toxicity, exact and near de-duplication, mixing, BPE encoding.

Each stage works on all that the stage before it kept; its result is stored in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from corpusloom.llm.common import documents, fresh, stored, text_of

WEIGHTS, SHARE, MOST = [3, 1, 2], 1.5, 2.0
#: Half the operator's own block: executors come to this stage with their memory in use.
BLOCK_CHARS = 4_000_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of ``sf_dir``, scores below 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("toxicity")
    return toxicity.scored(docs, model, score=score).filter(F.col(score) < 0.5).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of equal texts the one with the largest doc_id, and of rows equal in both any one."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    kept = exact_dedup.dedup(rows, carry=["doc", "doc_id", "text"]).filter("kept")
    return kept.withColumn("text", text_of()).dropDuplicates(["doc_id", "text"]).select("doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest doc_id."""
    classes = minhash.near_classes(docs)
    stays = classes.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("_stays")).select("_stays.node")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.md5(text_of()).alias("node"))
    return rows.join(stays, "node", "left_semi").dropDuplicates(["node"]).select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = mixing.mix(docs, WEIGHTS, SHARE, MOST).filter("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with token ids, ``ids``, in place of the text (``ids_`` where they have a column ``ids``)."""
    return bpe.encode(docs, block_chars=BLOCK_CHARS)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding", encoded),
]

#: Learned scores, sampling and tokenization are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
