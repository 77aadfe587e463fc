"""From raw documents to packed training sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.fm_decontam import without_contaminated
from voxelflow.llm.line_dedup import drop_lines
from voxelflow.llm.packing import pack_documents
from voxelflow.llm.shared import free_prefix, materialize
from voxelflow.llm.simhash_dedup import SIMILAR, fingerprint_of, rooted_groups
from voxelflow.llm.toxicity_gru import THRESHOLD, fit_toxicity, toxicity_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    net = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(net, F.col("text")) < THRESHOLD)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three or more share (but in the largest id), and with its new length."""
    cut = drop_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of texts that share 0.8 or more of their five-word shingles, as the fingerprints of `SIMILAR` tell.

    Of rows that share that id, the one with the least fingerprints, then the least row. Documents without an id stay; null
    and wordless texts are one group.
    """
    named, own = docs.where("doc_id IS NOT NULL"), free_prefix(docs.columns)
    groups = materialize(rooted_groups(named, SIMILAR), "near-copies")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.expr("doc_id = component_id")).alias("least")).where("least")
    single = named.join(ids.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    # only rows that share an id are told apart by their fingerprints
    prints = {own + str(n): fingerprint_of(F.col("text"), n) for n in SIMILAR.shingles}
    least = groups.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min(F.struct("fp", "fp2")).alias("p")).select("doc_id", *(F.col(f"p.{fp}").alias(c) for fp, c in zip(("fp", "fp2"), prints, strict=True)))
    shared = named.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").withColumns(prints).join(least, ["doc_id", *prints], "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = shared.groupBy("doc_id", *prints).agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *(F.col("row")[c].alias(c) for c in rest))
    return single.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages, as they are."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset; the word table is small, as workers that ran other stages are still there."""
    return pack_documents(docs, cached_words=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The network, fingerprints' reachability and the packing plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
