"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.encoding import count_tokens, decode, encode, encode_with_offsets
from lodestrata.llm.packing import pack
from lodestrata.llm.records import table
from lodestrata.llm.splitting import split_oversized
from lodestrata.staging import stage


def _limit(spark: SparkSession, directory: str, name: str) -> tuple[str, int, int]:
    row = table(spark, directory, "token_limits").where(F.col("limit_name") == name).first()
    return row["tokenizer"], int(row["max_tokens"]), int(row["overlap_tokens"])


def _documents(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", *columns, "text")


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode(_documents(spark, directory))


def p8_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Texts that differ from the decoding of their ids: none."""
    texts = _documents(spark, directory)
    back = decode(encode(texts)).withColumnRenamed("text", "back")
    return texts.join(back, "doc_id").where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).select("doc_id")


def p8_offsets(spark: SparkSession, directory: str) -> DataFrame:
    return encode_with_offsets(_documents(spark, directory))


#: Target token shares by kind of ``p9_mixed``: code and its patches first, what explains them next.
KIND_SHARES = {"code": 0.35, "patch": 0.2, "advisory": 0.15, "trace": 0.1, "review": 0.1, "config": 0.05, "bundle": 0.05}


def _counted(spark: SparkSession, directory: str, source: str) -> tuple[DataFrame, int]:
    """item, source (a column of the documents), n_tokens, and the capacity of a container."""
    tokenizer, capacity, _ = _limit(spark, directory, "pack_train")
    counted = count_tokens(_documents(spark, directory, source), "doc_id", source, name=tokenizer)
    return counted.withColumnsRenamed({"doc_id": "item", source: "source"}), capacity


def p9_pack(spark: SparkSession, directory: str) -> DataFrame:
    return pack(*_counted(spark, directory, "source")).withColumnRenamed("item", "doc_id")


def p9_whole(spark: SparkSession, directory: str) -> DataFrame:
    """Each document in the containers: whether its tokens are all there, once and in order, and it is whole if it fits."""
    counted, capacity = _counted(spark, directory, "source")
    counted = stage(counted, "counted")
    got = pack(counted, capacity).groupBy("item").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("packed"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("distinct"), F.max("n_tokens").alias("most")
    )
    right = (F.col("packed") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("distinct") == F.col("pieces")) & (F.col("most") <= capacity)
    fits = F.when(F.col("n_tokens") <= capacity, F.col("pieces") == 1).otherwise(F.col("pieces") == F.ceil(F.col("n_tokens") / capacity))
    return got.join(counted.select("item", "n_tokens"), "item").select(F.col("item").alias("doc_id"), (right & fits).alias("whole"))


def p9_overfull(spark: SparkSession, directory: str) -> DataFrame:
    """Containers of more tokens than the capacity: none."""
    capacity = _limit(spark, directory, "pack_train")[1]
    return p9_pack(spark, directory).groupBy("container").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > capacity)


def p9_mixed(spark: SparkSession, directory: str) -> DataFrame:
    """The documents packed so that every window has the token shares of ``KIND_SHARES``, while its kinds last."""
    counted, capacity = _counted(spark, directory, "kind")
    return pack(counted, capacity, KIND_SHARES).withColumnsRenamed({"item": "doc_id", "source": "kind"})


def p9_mixed_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Mean token share of each kind over the windows that have all kinds, beside its target."""
    tokens = p9_mixed(spark, directory).where("window <> 'f' and kind is not null").groupBy("window", "kind").agg(F.sum("n_tokens").alias("tokens"))
    whole = tokens.groupBy("window").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("kinds")).where(F.col("kinds") == len(KIND_SHARES))
    target = F.create_map(*[F.lit(x) for kv in KIND_SHARES.items() for x in kv])
    share = F.col("tokens") / F.col("all_tokens")
    return tokens.join(whole, "window").groupBy("kind").agg(F.count("*").alias("windows"), F.avg(share).alias("share"), F.stddev(share).alias("deviation")).withColumn("target", F.try_element_at(target, F.col("kind")))


def p9_report(spark: SparkSession, directory: str) -> DataFrame:
    """Containers, tokens and unused room of the whole packing."""
    capacity = _limit(spark, directory, "pack_train")[1]
    boxes = p9_pack(spark, directory).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return boxes.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        (F.count("*") * capacity - F.coalesce(F.sum("used"), F.lit(0))).alias("unused"),
        F.max("used").alias("fullest"),
    )


def p9_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """Token share of each source in each window."""
    tokens = p9_pack(spark, directory).where("window <> 'f'").groupBy("window", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = tokens.groupBy("window").agg(F.sum("tokens").alias("all_tokens"))
    return tokens.join(whole, "window").select("window", "source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"))


def p10_pieces(spark: SparkSession, directory: str, with_text: bool = True) -> DataFrame:
    tokenizer, limit, overlap = _limit(spark, directory, "split_train")
    return split_oversized(_documents(spark, directory), limit, overlap, with_text=with_text, name=tokenizer)


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return p10_pieces(spark, directory, with_text=False).where("piece = 0").select("doc_id")


def p10_rejoined(spark: SparkSession, directory: str) -> DataFrame:
    """Each document: whether its pieces, without what they repeat, are its text, and none is above the limit."""
    limit = _limit(spark, directory, "split_train")[1]
    pieces = p10_pieces(spark, directory)
    before = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("piece"))  # a document's pieces, not a group of documents
    new = pieces.withColumn("before", F.coalesce(before, F.lit(0))).select(
        "doc_id",
        "piece",
        "n_tokens",
        ((F.col("start_char") <= F.col("before")) & (F.col("end_char") > F.col("before"))).alias("adjoins"),
        F.expr("substring(text, cast(before - start_char + 1 as int), cast(end_char - before as int))").alias("fresh"),
    )
    joined = new.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "fresh"))), lambda p: p["fresh"]), "").alias("joined"),
        (F.bool_and("adjoins") & (F.max("n_tokens") <= limit)).alias("right"),
    )
    texts = _documents(spark, directory)
    return texts.join(joined, "doc_id", "left").select("doc_id", (F.col("joined").isNull() | (F.col("right") & (F.col("joined") == F.col("text")))).alias("rejoined"))


def p10_places(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces, tokens they have and repeat, and those that repeat fewer than asked for."""
    overlap = _limit(spark, directory, "split_train")[2]
    later = F.col("piece") > 0
    return p10_pieces(spark, directory, with_text=False).agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.sum("repeated_tokens").alias("repeated"), F.count_if(later & (F.col("repeated_tokens") < overlap)).alias("repeat_fewer")
    )


QUERIES = {
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p8_offsets": p8_offsets,
    "p9_pack": p9_pack,
    "p9_report": p9_report,
    "p9_mixture": p9_mixture,
    "p9_whole": p9_whole,
    "p9_overfull": p9_overfull,
    "p9_mixed": p9_mixed,
    "p9_mixed_shares": p9_mixed_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
    "p10_rejoined": p10_rejoined,
    "p10_places": p10_places,
}
#: What has to hold whatever the ids are: SQL has no tokenizer.
ORACLES: dict[str, str] = {
    "p8_roundtrip": "SELECT doc_id FROM documents WHERE FALSE",
    "p9_whole": "SELECT doc_id, TRUE AS whole FROM documents WHERE text <> ''",
    "p9_overfull": "SELECT '' AS container, CAST(0 AS BIGINT) AS used WHERE FALSE",
    "p10_rejoined": "SELECT doc_id, TRUE AS rejoined FROM documents",
}
