"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows that its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm import decontamination, ngram_join, piece_sampling, quality, repeats
from weekgrain.llm.common import member_bits, member_flag, may_be_member, stored, table, without_ids


BATCH_ROWS = 1_000


def in_small_batches(stage):
    """Whole texts go to Python a thousand rows at a time: the stages run one after another in the same workers, which keep what they once held."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but doc_id and text under names that no operator adds, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(n) for c, n in names.items()]), names


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that the quality classifier takes for good."""
    mine, names = numbered(docs)
    return quality.classified(mine).where("keep").select([F.col(n).alias(c) for c, n in names.items()])


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that five-word shingles link at 0.8 or more, the one with the smallest doc_id stays; of rows with equal doc_id and text one.

    Different texts under one doc_id are linked and judged apart. Texts without a doc_id are linked with nothing and all stay.
    """
    mine, back = numbered(docs)
    # an id that holds different texts: each of them goes under a number of its own
    several = mine.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = stored(several.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("differ")), "repeated")
    flagged = member_flag(mine, member_bits(several.where("differ")), "_apart").withColumn("_apart", F.col("_apart") & F.col("doc_id").isNotNull())
    keyed = flagged.withColumn("_key", F.when(F.col("_apart"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = ngram_join.similar_documents(keyed, size=5, percent=80, doc_id="_key").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("comp"))
    pairs = stored(found.where("_key != comp").distinct(), "linked")
    nodes = pairs.union(pairs.select("comp", "comp")).distinct()
    real = keyed.where("_apart").select("_key", F.col("doc_id").alias("_real")).distinct()
    first = nodes.join(real, "_key", "left").groupBy("comp").agg(F.min(F.struct(F.coalesce("_real", "_key").alias("real"), "_key"))["_key"].alias("_key"))
    rest = nodes.select("_key").join(first.select("_key"), "_key", "left_anti")
    left = without_ids(keyed.drop("_apart"), stored(rest, "copies"), "_key").drop("_key")
    bits = member_bits(several)
    with_id = left.where("doc_id is not null")
    out = left.where("doc_id is null").unionByName(may_be_member(with_id, bits, keep=False)).unionByName(may_be_member(with_id, bits).dropDuplicates(["doc_id", "text"]))
    return out.select([F.col(n).alias(c) for c, n in back.items()])


@in_small_batches
def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all strings of 200 bytes that stand anywhere else as well; what is left of a character at a cut goes too. n_chars follows the text."""
    mine, back = numbered(docs)
    cut = repeats.without_repeats(mine, 200, as_text=True)
    out = cut.select([F.col("kept" if c == "text" else n).alias(c) for c, n in back.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that cover a benchmark item by 0.8 or more."""
    mine, names = numbered(docs)
    found = decontamination.judged(mine, table(spark, sf_dir, "benchmark"), threshold=0.8)
    return found.where("not contaminated").select([F.col(n).alias(c) for c, n in names.items()])


@in_small_batches
def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text in distinct sampled segmentations and decodes them again: all columns, then n_samples and samples with their ids.

    Input columns of these two names are replaced.
    """
    from weekgrain.llm.catalog import tokenizer

    own = [c for c in docs.columns if c not in ("n_samples", "samples")]
    mine = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").alias("body"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    out = piece_sampling.sampled(mine, tokenizer("piece_bpe_32k.model"), k=2, doc_id="key", text="body", keep=tuple(f"c{i}" for i in range(len(own))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "n_samples", "samples")


STAGES = [("quality", good_quality), ("near duplicates", one_of_each_group), ("repeated passages", without_passages), ("benchmark passages", without_benchmark),
          ("pieces", sampled_pieces)]
