"""The registered queries of this subpackage, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .decontaminate import contaminated
from .html_main import main_text_of
from .langid import fit_languages, language_of
from .lattice_dedup import near_duplicate_vectors
from .lexical_search import ORACLE as lexical_oracle
from .lexical_search import lexical_search
from .line_dedup import dedup_page_lines
from .line_dedup import oracle as line_oracle
from .mixture import mix_sources
from .ngram_join import ngram_jaccard_join
from .shard_pack import pack_shards
from .substring_dedup import ORACLE as substring_oracle
from .substring_dedup import dedup_substrings
from .token_align import align_tokens
from .token_order import materialise_training_order
from .toxicity import fit_toxicity, toxicity_of


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no rest mod 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size of its shingle set, class, component and number of links."""
    return ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), count_links=True)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that holds a benchmark item and that item; clean documents have none."""
    found = contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumn("contaminated", F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out()))
    said = docs.select("doc_id", held_out().alias("held_out"), language_of(model, "text").alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous", "p.rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out() & F.col("toxic").isNotNull())
    judge = fit_toxicity(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_of(judge, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the lines that are boilerplate of its host."""
    return dedup_page_lines(table(spark, sf_dir, "pages"))


def op6_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together, by the law `bytes`."""
    out = pack_shards(spark, table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9."""
    return near_duplicate_vectors(spark, table(spark, sf_dir, "embeddings"), limit=0.9)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    bounded_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text_of("html").alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence of 128 token ids: its document, global slot, shard and place in the shard's file."""
    return materialise_training_order(spark, table(spark, sf_dir, "documents"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, sources weighing 5, 2, 1 in turn and read three times at most."""
    out = mix_sources(spark, table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two public tokenizers on every document, and how common the links are."""
    return align_tokens(spark, table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when passages of 50 words that a document before it has are removed."""
    out = dedup_substrings(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    found = lexical_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_shard_packing": op6_shard_packing,
    "op7_lattice_near_dedup": op7_lattice_near_dedup,
    "op8_html_main_text": op8_html_main_text,
    "op9_training_order": op9_training_order,
    "op10_source_mixture": op10_source_mixture,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {"op5_line_dedup": line_oracle(), "op12_substring_dedup": substring_oracle, "op13_lexical_search": lexical_oracle}
