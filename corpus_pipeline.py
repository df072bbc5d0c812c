"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``.

Any column may hold nulls, and an empty table passes all stages as one. Texts of any length are read whole. Rows without doc_id pass the stage
of near copies, which names groups by id, and the others like any row; rows with one id and different texts are told apart by their texts. Columns of other names are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.llm.common import Scratch, table, without_ids
from glyphtally.llm.decontaminate import decontaminate
from glyphtally.llm.langid import fit_languages, language_of
from glyphtally.llm.mixture import repeated
from glyphtally.llm.ngram_join import ngram_jaccard_join, row_key
from glyphtally.llm.shard_pack import pack_shards


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language codes reject, and gives those without ``lang`` the language found.

    Rejected are texts without letters, null and empty ones among them, texts whose nearest codeword has as much against it as for it, and texts whose
    n-grams are far from those of every language of the table: foreign scripts, noise, encoded data.
    """
    model = fit_languages(docs)
    said = docs.withColumn("__language", language_of(model, "text")).where(~F.col("__language")["rejected"])
    return said.withColumn("lang", F.coalesce("lang", F.col("__language")["lang"])).drop("__language")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; of repeated rows with that id, all."""
    scratch = Scratch(spark, "near-copies")
    groups = scratch.write(ngram_jaccard_join(spark, docs, row_keys=True), "groups")
    keyed = docs.withColumn("__row", row_key("doc_id", "text"))
    return without_ids(keyed, "__row", groups.where("doc_id <> component_id"), "row_key").drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, those without doc_id as well."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as rows of their own.

    The one document per source that the mix takes in part counts as taken where that part is at least half. Documents
    without words are not taken.
    """
    return repeated(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; repeated rows share the shard and have slots of their own."""
    return pack_shards(spark, docs, shards=24)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixture", mix),
    ("shard_packing", shard),
]

#: Hash-ordered sampling, learned models and packing have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
