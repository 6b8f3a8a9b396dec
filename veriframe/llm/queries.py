"""The queries opN_<name> of the corpus operators over the tables in sf_dir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, language, mixing, ogg, packing, quality, secrets, sentencepiece_codec, simhash, spelling, tokens, toxicity
from .common import held_out, materialise, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(F.filter("spans", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["copied"])).cast("bigint").alias("n_owner_specific"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["owners"], x["repositories"])), ",").alias("owners_repositories"),
    )


#: A conversation that holds the template's own control strings.
AWKWARD = "\\### Assistant: </turn> ok"


def as_layouts(records: DataFrame) -> DataFrame:
    """(conv_id, json): conversations as four layouts of JSON, by id, as a corpus of several origins has them.

    Lists of messages; turns; senders and values where no role would be renamed; and messages in a
    wrapper, with parts as content and with metadata."""
    turn = lambda role, text: lambda t: F.struct(t["role"].alias(role), t["text"].alias(text))
    parts = lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content"))
    plain = ~F.exists("turns", lambda t: t["role"].isin("human", "gpt"))
    way = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4))
    messages = F.to_json(F.struct(F.transform("turns", turn("role", "content")).alias("messages")))
    return records.select(
        "conv_id",
        F.when(way == 1, F.to_json(F.struct(F.transform("turns", turn("role", "text")).alias("turns"))))
        .when((way == 2) & plain, F.to_json(F.struct(F.transform("turns", turn("from", "value")).alias("conversations"))))
        .when(way == 3, F.to_json(F.struct(F.struct(F.transform("turns", parts).alias("messages")).alias("data"), F.struct(F.lit("dump").alias("origin")).alias("meta"))))
        .otherwise(messages).alias("json"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], "conv_id long, turn long, role string, text string")
    done = chat.format_records(as_layouts(chat.conversations_as_records(rows.unionByName(added))), "json")
    back = done.select(
        F.col("record.conv_id").alias("conv_id"), "layout", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "layout",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(quality.measure(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("doc", F.col("doc").dropFields("text")))
    judged = quality.judge(found, quality.fit(found))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"), "n_chunks", "low_chunks", "high_chunks"
    )


#: Documents that score this much are called toxic.
TOXIC = 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )


#: Texts of more tokens than this are over the limit.
TOKEN_LIMIT = 512


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chunks")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return named.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ogg.write_media(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return ogg.read_media(stored.select("doc.doc_id", "n_bytes", "media")).select("row.doc_id", "row.n_bytes", "read.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    key = mixing.order_key(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    docs = materialise(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), key.alias("key")))
    taken = mixing.systematic_copies(docs, size=F.col("size"), key=F.col("key"))
    return taken.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = sentencepiece_codec.coded(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.written(F.col("fp")).alias("fingerprint"), "component_id")


#: One run of a document in so many loses a letter.
MISSPELT = 199


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words, a null doc_id is an empty one in the digest, copies of a document count each;
    the most frequent near word is the form, ties to the first by code point."""
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), drop_every=MISSPELT))


#: Clusters, rounds, and what stands before an id whose digest orders the first centroids.
CLUSTERS, ROUNDS, SALT = 8, 10, "3:"


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length, or with a null or non-finite component, go; rows of one vec_id stay each, a null
    vec_id is an empty one in the digest, and equal digests are ordered by their vectors."""
    order = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("doc.vec_id").cast("string"), F.lit(""))), 256)
    found = centroids.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), order, CLUSTERS, ROUNDS)
    return found.select("doc.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is the end token alone; rows of one doc_id, or of none, are documents of their own."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_chat_format": op2_chat_format,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_language": op6_language,
    "op7_ogg": op7_ogg,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}
