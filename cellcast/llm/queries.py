"""The operators on the driver's tables, with the columns their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import (
    bit_search, byte_bpe, cotraining, fill_middle, filter_audit, jaccard_join, license_scan, packing, pii, preference,
    quality_rules, secret_ledger, winnowing,
)
from cellcast.llm.common import documents, listed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that cuts texts into pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digests(spans: str, base: tuple[str, ...]):
    kept = F.filter(spans, lambda s: s["kind"].isin(*base))
    return F.sha2(listed(kept).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans")


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    out = pack(documents(spark, sf_dir))
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def pack(docs: DataFrame) -> DataFrame:
    """Packing by the 50k vocabulary: the .tiktoken file has the ids of the .json file."""
    path, pattern = _vocabulary()
    return packing.pack_documents(docs, path, pattern, {"<|endoftext|>": 50256})


@register
def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer against itself with half of its last answer."""
    turns = preference.halved_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return preference.format_pairs(turns).select(
        F.col("pair_id").alias("conv_id"), "n_shared", "prompt", "chosen", "rejected",
        spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"),
    )


ORACLES["op2_preference"] = preference.oracle_sql()


@register
def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from two views that teach each other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = cotraining.score(documents(spark, sf_dir), labels)
    return out.select("doc_id", "content_score", "meta_score", "score", "kept")


@register
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(documents(spark, sf_dir))


ORACLES["op4_license_scan"] = license_scan.oracle_sql()


@register
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to."""
    path, pattern = _vocabulary()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = byte_bpe.round_trip(docs, path, pattern)
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    out = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[_count("personal", k) for k in pii.BASE], *_digests("personal", pii.BASE))


@register
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct content scanned once."""
    out = secret_ledger.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = secret_ledger.BASE
    return out.select("doc_id", *[_count("secrets", k) for k in base], *_digests("secrets", base))


@register
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    out = winnowing.fingerprint(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        winnowing.as_text(F.col("prints")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@register
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision over every document."""
    out = quality_rules.score(documents(spark, sf_dir).select("doc_id", "text"))
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"features.{n}") for n in named], "base_failed", "kept", "posterior")


@register
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles overlap by 90 per cent."""
    return jaccard_join.join(documents(spark, sf_dir))


@register
def op11_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return bit_search.search(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLES["op11_bit_search"] = bit_search.oracle_sql()


@register
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.cells(documents(spark, sf_dir), labels))


ORACLES["op12_filter_audit"] = filter_audit.oracle_sql()


@register
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in its middle, and rebuilt from that."""
    out = fill_middle.transform(documents(spark, sf_dir))
    rebuilt = fill_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(rebuilt).alias("restored_sha256"),
    )


ORACLES["op13_fill_middle"] = fill_middle.oracle_sql()
