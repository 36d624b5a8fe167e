"""Job 2: an instruction-tuning set out of recorded conversations, rebuilt as a whole.

    python -m jobs.instruction_set --conversations PATH --out DIR [--config FILE] [--master M]

Turns become question and answer rounds, rounds a prompt of the model's template. Below ``out``:

- ``records``, JSON lines by ``split`` and ``bucket``: ``conv_id, n_rounds, n_words, prompt``. The split comes of a hash of the
  first question, so that conversations which open alike never lie in two splits; the bucket is the length in words,
  by powers of two, as batches are made of records of like length.
- ``refused``, JSON lines by ``reason``: ``empty`` (no round), ``unpaired`` (a question without an answer), ``too_long``
  (beyond ``max_words`` or ``max_turns``), ``copy`` (the prompt of a conversation with a smaller id).
- ``manifest``, one JSON file: records and words per split and bucket, refused ones per reason.

Lengths are counted before turns are gathered, so only conversations that fit are, and no task holds an unbounded one. A rerun
replaces the output by the same rows. A leading turn that isn't the user's is skipped; a null text counts as empty;
turns without a conversation are left out; repeated turns count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions import chat

DEFAULTS = {"template": "llama", "max_words": 2048, "max_turns": 64, "shares": {"train": 0.9, "valid": 0.05, "test": 0.05}, "salt": ""}
RECORD = "conv_id bigint, n_rounds int, n_words bigint, prompt string, split string, bucket int"
REFUSED = "conv_id bigint, n_rounds int, n_words bigint, reason string"


def rounds(turns: DataFrame, max_words: int, max_turns: int) -> DataFrame:
    """``conv_id, n_turns, n_words, pairs``; ``pairs`` is null for conversations that are too long or unpaired."""
    text = F.coalesce("text", F.lit(""))
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", text.alias("text"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.size(chat.words(F.col("text"))).cast("bigint")).alias("n_words"))
    sizes = sizes.withColumn("fits", (F.col("n_words") <= max_words) & (F.col("n_turns") <= max_turns))
    # Only turns of conversations that fit are gathered: max_turns of them at most.
    few = turns.join(sizes.where("fits").select("conv_id"), "conv_id", "left_semi")
    held = few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    pairs = chat.rounds(F.transform("a", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    return sizes.join(held.select("conv_id", pairs.alias("pairs")), "conv_id", "left")


def split_of(question, shares: dict, salt: str) -> F.Column:
    """A split by the first 52 bits of a hash: as many texts go to each as its share says, and equal ones to the same."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(salt), question)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    total, upto, out = float(sum(shares.values())), 0.0, None
    for name, share in shares.items():
        upto += share / total
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return out.otherwise(list(shares)[-1])


def records(turns: DataFrame, config: dict) -> DataFrame:
    """A row per conversation: ``conv_id, n_rounds, n_words, prompt, split, bucket, reason``; ``reason`` is null for records."""
    got = rounds(turns, config["max_words"], config["max_turns"])
    reason = F.when(~F.col("fits"), "too_long").when(F.col("pairs").isNull(), "unpaired").when(F.size("pairs") == 0, "empty")
    got = got.withColumn("reason", reason).withColumn("prompt", F.when(reason.isNull(), chat.prompt(F.col("pairs"), chat.template(config["template"]))))
    got = got.withColumn("mark", F.sha2("prompt", 256))
    first = got.where("mark is not null").groupBy("mark").agg(F.min("conv_id").alias("first"))
    got = got.join(first, "mark", "left").withColumn("reason", F.when(F.col("first") < F.col("conv_id"), "copy").otherwise(F.col("reason")))
    kept = F.col("reason").isNull()
    bucket = F.when(F.col("n_words") <= 1, 0).otherwise(F.length(F.bin(F.col("n_words") - 1)))  # the power of two at or above
    return got.select(
        "conv_id", F.when(F.col("pairs").isNotNull(), F.size("pairs")).alias("n_rounds"), "n_words", F.when(kept, F.col("prompt")).alias("prompt"),
        F.when(kept, split_of(F.col("pairs")[0]["question"], config["shares"], config["salt"])).alias("split"), F.when(kept, bucket).alias("bucket"), "reason",
    )


def run(spark: SparkSession, conversations: str, out: str, config: dict) -> DataFrame:
    """Writes the set below ``out``; returns all its conversations, ``prompt`` null for refused ones. ``config`` as DEFAULTS."""
    turns = spark.read.parquet(conversations)
    common.log_table("read", conversations, turns, turns.count())
    every = records(turns, config)
    # Both tables come of one plan: kept together first, then dealt to their folders.
    every.write.mode("overwrite").parquet(f"{out}/conversations")
    every = spark.read.schema(every.schema).parquet(f"{out}/conversations")
    every.where("reason is null").select("conv_id", "n_rounds", "n_words", "prompt", "split", "bucket").repartition("split", "bucket", F.pmod(F.xxhash64("conv_id"), F.lit(16))).write.mode("overwrite").partitionBy("split", "bucket").json(f"{out}/records")
    every.where("reason is not null").select("conv_id", "n_rounds", "n_words", "reason").write.mode("overwrite").partitionBy("reason").json(f"{out}/refused")
    kept, refused = spark.read.schema(RECORD).json(f"{out}/records"), spark.read.schema(REFUSED).json(f"{out}/refused")
    manifest = every.groupBy("split", "bucket", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words")).orderBy("reason", "split", "bucket")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")  # some dozens of rows
    for name, df in (("records", kept), ("refused", refused)):
        common.log_table("wrote", f"{out}/{name}", df, df.count())
    none = lambda kind: F.lit(None).cast(kind)
    return kept.select("*", none("string").alias("reason")).unionByName(refused.select("conv_id", "n_rounds", "n_words", none("string").alias("prompt"), none("string").alias("split"), none("int").alias("bucket"), "reason"))


def main(argv: list[str] | None = None) -> None:
    args = common.command_line(argv, __file__, __doc__.split("\n")[0], {"conversations": "table of turns (Parquet)", "out": "output folder"})
    spark = common.session("instruction_set", args.master)
    try:
        run(spark, args.conversations, args.out.rstrip("/"), common.read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
