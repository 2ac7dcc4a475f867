"""Registered queries of the operators: name -> query and, where SQL can say it, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog.registry import Query
from . import ann, byte_bpe, collocations, decontaminate, html_extract, language_id, lexical, licenses, mixture, near_dedup, pii, secret_scan, shards, sql
from .common import stored, table
from .spans import digest_columns

QUERIES: dict[str, Query] = {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = Query(fn, text)
        return fn
    return add


def held_out():
    """True for the fifth of the documents that language profiles don't learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op4_language_id", sql.LANGUAGE_ID)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents")
    rows = language_id.learned(docs.where(~held_out()))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), rows).drop("text")


@query("op1_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the id of its class of near copies, and whether it is the one that stays."""
    found = near_dedup.classes(table(spark, folder, "documents"))
    return found.withColumn("stays", F.col("doc_id") == F.col("class_id"))


@query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it covers one half or more."""
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_mixture", sql.MIXTURE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = stored(table(spark, folder, "documents").select("doc_id", "source", mixture.word_count().alias("words")), "words")
    return mixture.take(sized, size=F.col("words")).select("row.doc_id", "size", "source_size", "target", "taken")


@query("op8_shards", sql.SHARDS)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; sizes near equal."""
    found = shards.assign(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_secrets")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.find(table(spark, folder, "documents")).select("doc_id", *digest_columns(secret_scan.KINDS))


@query("op9_pii")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find(table(spark, folder, "documents")).select("doc_id", *digest_columns(pii.KINDS))


@query("op10_licenses", sql.licenses())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses of every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    everything = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
                        F.array_join(everything, ",").alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)).alias("score"))


@query("op3_nearest_neighbours", sql.NEIGHBOURS)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest vectors of every vector whose id is divisible by 20."""
    coded, size = ann.index(table(spark, folder, "embeddings"))
    return ann.search(coded, size, F.col("vec_id") % 20 == 0)


@query("op2_main_text", sql.MAIN_TEXT)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of the ids of every document, and digest of the bytes decoded from them."""
    import public_tokenizers

    known = byte_bpe.tables(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return byte_bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), known, public_tokenizers.PATTERN).drop("text")


@query("op12_lexical_search", sql.LEXICAL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty documents that score highest for every benchmark item."""
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_collocations", sql.COLLOCATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The first two thousand phrases of every language whose words go together."""
    return collocations.collocations(table(spark, folder, "documents"))
