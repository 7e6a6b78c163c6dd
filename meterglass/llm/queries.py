"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.llm import bpe, chat_format, language_id, license_scan, mixing, periodic_runs, pivot_search, prefix_trie, quality_model, substring_dedup
from meterglass.llm.common import WORD, cut_lineage, documents, whole_text
from meterglass.llm.exact_dedup import exact_groups
from meterglass.llm.oracles import ORACLES
from meterglass.llm.quality_rules import POLICIES, apply_policy, ledger
from meterglass.llm.simhash import near_groups


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(documents(spark, sf_dir)), POLICIES["web"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.round_trip(documents(spark, sf_dir), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = chat_format.turns_of_frame(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = turns.unionByName(chat_format.turns_of_records(planted))
    rows = chat_format.read_back(chat_format.format_turns(turns))
    said_all = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_all, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), with_digest=True)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.profiles(docs))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a period put into the words of a tenth of them, as the contract of op11 states; a null id counts as ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    # An array of one, so that the words are taken once and not for each place.
    words = F.array(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0)))
    return docs.withColumn("text", F.when(h % 10 == 0, F.transform(words, planted)[0]).otherwise(whole_text()))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(with_periods(documents(spark, sf_dir)))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", periodic_runs.greatest_run(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A rebuilt conversation takes fewer turns than this from another one.
MOST_TAKEN = 9


def rebuilt(turns: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as the contract of op12 rebuilds them, and the length of every conversation.

    h of a null id is that of ''; it takes turns from none.
    """
    h = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % MOST_TAKEN
    taken = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    given = counts.select(F.col("conv_id").alias("b"), F.col("n").alias("n_base"))
    taken = taken.join(given, F.col("base") == F.col("b"), "left").drop("b")
    taken = taken.withColumn("n_taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    heads = turns.filter(F.col("pos") < MOST_TAKEN).withColumnRenamed("conv_id", "b")
    heads = taken.select("conv_id", "base", "n_taken").join(heads, (F.col("base") == F.col("b")) & (F.col("pos") <= F.col("n_taken")))
    own = taken.select(F.col("conv_id").alias("c"), "h", "n_taken")
    own = turns.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") > F.col("h")))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("n_taken"))
    columns = ("conv_id", "pos", "said", "n_bytes")
    length = F.col("n_taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    return heads.select(*columns).union(own.select(*columns)), taken.select("conv_id", length.alias("length"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, counts = prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    trie = prefix_trie.trie_of(*rebuilt(cut_lineage(turns), cut_lineage(counts)))
    nodes = trie.nodes.join(prefix_trie.listed_digests(trie.ends), "key", "left")
    none = F.sha2(F.lit(b""), 256)
    return nodes.drop("key").withColumn("ends_sha256", F.coalesce("ids_sha256", none)).drop("ids_sha256")


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(pivot_search.finite(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = rows.select("vec_id", whole.alias("v"))
    found = pivot_search.top_k(rows.filter("vec_id % 50 = 0"), rows)
    return found.withColumn("score", F.col("score").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_source_mixing,
        op4_license_scan,
        op5_bpe,
        op6_chat_format,
        op7_exact_dedup,
        op8_quality_classifier,
        op9_language_id,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_pivot_search,
    )
}

__all__ = ["ORACLES", "QUERIES"]
