"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a session on a local master may leave the setting out; it then gets a temporary folder that goes when
    the process ends. On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, **options: str) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: it cuts the lineage and survives lost
    executors, and later steps read it column by column. `options` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/dayspell-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id's text is divisible by `folds`; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learnable(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """Rows that a classifier may learn from: a known id that is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return c.isNotNull() & ~held_out(c, folds)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node that can be reached.

    Large-star and small-star rounds: each node's neighbours are linked to its smallest neighbour, first the larger
    ones, then the smaller ones, until every edge points at its component's smallest node. The minimum per node is a
    partial aggregate, so a hub that holds a third of all edges sends one row per task. Every round is a written
    table. Rows with a null end or equal ends bring no link (a self-loop still yields its node).
    """
    known = edges.select("a", "b").where("a is not null and b is not null")
    loops = known.where("a = b").select(F.col("a").alias("node")).distinct()
    links = staged(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def small_star(pairs: DataFrame) -> DataFrame:
        # pairs (a > b): every smaller neighbour of a, and a itself, is linked with the smallest one
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        moved = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return least.select("a", F.col("m").alias("b")).union(moved).distinct()

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def settled(pairs: DataFrame) -> bool:
        """Every node points at one other, which points nowhere."""
        ends = pairs.select(F.col("a").alias("b")).distinct()
        moving = pairs.join(ends, "b", "left_semi").select("a")
        return moving.union(pairs.groupBy("a").count().where("count > 1").select("a")).isEmpty()

    for _ in range(most_rounds):
        if settled(links):
            break
        links = staged(small_star(large_star(links)))
    else:
        raise RuntimeError("connected components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    every = found.union(roots)
    return every.union(loops.join(every, "node", "left_anti").select("node", F.col("node").alias("component")))


def joined_by_key(rows: DataFrame, by_key: DataFrame, key: str, most: int = 100_000, salts: int = 32) -> DataFrame:
    """`rows` with the columns of `by_key`, which has one row per value of `key` (null is a value).

    Up to `most` keys, counted first, are broadcast. Beyond that every key is repeated per salt and both sides meet on
    (key, salt), so rows of one key are dealt to several tasks.
    """
    named = by_key.withColumnRenamed(key, "j_key")
    if by_key.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("j_key"))).drop("j_key")
    left = rows.withColumn("j_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    right = named.withColumn("j_turn", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col(key).eqNullSafe(F.col("j_key")) & (F.col("j_salt") == F.col("j_turn"))
    return left.join(right, same).drop("j_key", "j_salt", "j_turn")
