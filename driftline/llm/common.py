"""Small expressions that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters outside words: ASCII without letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast function, which does the same there."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column) -> Column:
    """Runs of word characters. A split is much cheaper here than extracting every match, which copies the text each time."""
    return F.array_remove(F.split(text, f"{NOT_WORD}+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns and all others as the struct `rest`, so that no name of a step can meet one of the caller's."""
    others = [F.col(f"`{n}`") for n in docs.columns if n not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unpacked(rows: DataFrame, names: list[str], used: tuple[str, ...]) -> DataFrame:
    """The caller's columns again, in their order."""
    return rows.select([F.col(n) if n in used else F.col("rest").getField(n).alias(n) for n in names])


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs planned inside drop their shuffle files when they end. For steps that end in a checkpoint, which nothing reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(done: DataFrame) -> None:
    """Delete the files of a checkpointed frame that no later step reads: all that was made of it has its own checkpoint."""
    rdd = done._jdf.queryExecution().analyzed().rdd()
    file = rdd.getCheckpointFile()
    if file.isDefined():
        path = done.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(done.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BLOCK = 256


def running_totals(lengths: Column) -> Column:
    """Exclusive running sums of an array of integers, in blocks so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    def with_blocks(all_: Column, sums: Column) -> Column:
        return F.transform(
            all_,
            lambda x, i: total(F.slice(sums, F.lit(1), F.floor(i / BLOCK).cast("int")))
            + total(F.slice(all_, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
        )

    def body(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(all_, b * BLOCK + 1, BLOCK)))
        return let(F.when(F.size(all_) > 0, sums).otherwise(F.array().cast("array<bigint>")), lambda s: with_blocks(all_, s))

    return let(lengths, body)


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart; equal rows share it."""
    return F.concat_ws(":", F.char_length(text), F.xxhash64(text))  # never null

