"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidform.llm import archives, caps, interactions, licenses, minhash, mixing, packing, probing, quotes, repair, repeats, token_index, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_id_index")
def op1(spark, sf_dir):
    """Every document read back from its shard through the index."""
    docs = table(spark, sf_dir, "documents")
    shards = token_index.write_shards(docs)
    index = token_index.write_index(shards)
    found = token_index.locate(docs.select(F.col("doc_id").cast("bigint")), index, shards)
    return token_index.with_crc(token_index.read_documents(found, shards))


@query("op3_best_two_fit_packing")
def op3(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op8_mix_sources", mixing.SQL)
def op8(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_minhash_near_dedup")
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "sentences")


@query("op5_warc_dictionary", archives.SQL)
def op5(spark, sf_dir):
    listed = archives.write_archives(table(spark, sf_dir, "pages"))
    return archives.read_archives(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_quotation_linking")
def op2(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@query("op4_multiprobe_neighbours")
def op4(spark, sf_dir):
    return probing.nearest_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_cap_filter_near_dedup")
def op6(spark, sf_dir):
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_license_scan")
def op9(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_fm_index_dedup", repeats.SQL)
def op11(spark, sf_dir):
    done = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_filter_interactions", interactions.SQL)
def op12(spark, sf_dir):
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_conversation_repair", repair.SQL)
def op13(spark, sf_dir):
    return repair.repaired_after_damage(table(spark, sf_dir, "conversations"))
