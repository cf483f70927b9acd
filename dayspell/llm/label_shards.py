"""Balanced label propagation of documents into shards.

Documents with equal texts are linked. Every document starts in a home shard; in each round the linked ones move towards
the shard that holds most of their neighbours, as far as that shard's quota has room. What no link holds fills the
shards up, so that row counts differ by one at most, while few links are cut (only groups that exceed a quota, and
one group at a quota's edge, are split). DataFrame operations only.

State is kept per (group, shard) as a count, because members of a group are interchangeable; a document finds its
place through its position in the group. Groups are dealt over `salts` atoms each, and all ranks are running sums over
hash buckets, so no task holds a whole group or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import staged

LAW = "rows"


def _bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _starts(rows: DataFrame, amount: str, keys: list[str], bucket: str) -> DataFrame:
    """keys, bucket, start: the sum of `amount` over all earlier buckets of the same keys (one row a bucket)."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(amount).alias("amount"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("start"))


def _running(rows: DataFrame, amount: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Adds `before`: the sum of `amount` over the rows ahead within `keys`, by hash bucket and then by `order`."""
    dealt = rows.withColumn("bucket", _bucket(F.struct(*order), buckets))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (dealt.join(_starts(dealt, amount, keys, "bucket"), [*keys, "bucket"])
            .withColumn("before", F.col("start") + F.col("inside")).drop("bucket", "inside", "start"))


def _by_shard(values: list[int], shard: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(shard) + 1)


def _held(parts: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in parts.groupBy("shard").agg(F.sum("n")).collect()}
    return [int(found.get(s, 0) or 0) for s in range(shards)]


def propagate(parts: DataFrame, quotas: list[int], rounds: int = 8, buckets: int = 1024) -> DataFrame:
    """Moves the counts of `parts` (digest, shard, n) until no move helps or has room.

    Each round joins every part with its group's best shard (most members; equal ones by a hash) and lets it move there
    if it holds fewer. A shard takes in what its quota leaves and, in every other round, as much as wishes to leave
    it, so full shards can swap; the rounds between look only at shards with room. Of all that wish to enter a shard,
    those come in that the running sum in hash order allows, the last one in part.
    """
    shards, idle = len(quotas), 0
    draw = F.xxhash64("digest", "shard")
    for turn in range(rounds):
        held = _held(parts, shards)
        room = [max(0, q - h) for q, h in zip(quotas, held, strict=True)]
        swaps = turn % 2 == 0
        best = (parts.where(_by_shard([int(swaps or r > 0) for r in room]) > 0).groupBy("digest")
                .agg(F.max(F.struct("n", draw.alias("draw"), "shard")).alias("top"))
                .select("digest", F.col("top.shard").alias("to"), F.col("top.n").alias("most"), F.col("top.draw").alias("most_draw")))
        wish = (parts.withColumn("draw", draw).join(best, "digest")
                .where("shard <> to and (n < most or (n = most and draw < most_draw))").select("digest", "shard", "to", "n"))
        wish = staged(wish)
        if swaps:
            room = [r + w for r, w in zip(room, _held(wish, shards), strict=True)]
        moves = (_running(wish, "n", ["to"], ["digest", "shard"], buckets)
                 .withColumn("moved", F.least("n", F.greatest(F.lit(0), _by_shard(room, "to") - F.col("before"))))
                 .where("moved > 0").select("digest", "shard", "to", "moved"))
        moves = staged(moves)
        if moves.isEmpty():
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        changes = (moves.select("digest", "shard", (-F.col("moved")).alias("n"))
                   .union(moves.select("digest", F.col("to").alias("shard"), F.col("moved").alias("n"))))
        parts = staged(parts.select("digest", "shard", "n").union(changes).groupBy("digest", "shard")
                       .agg(F.sum("n").alias("n")).where("n > 0"))
    return parts


def _within(parts: DataFrame, quotas: list[int], buckets: int) -> DataFrame:
    """`parts` cut to the quotas, with slot (rows ahead in the shard)."""
    kept = _running(parts, "n", ["shard"], ["digest"], buckets)
    kept = kept.withColumn("n", F.least("n", F.greatest(F.lit(0), _by_shard(quotas) - F.col("before"))))
    return kept.where("n > 0").select("digest", "shard", "n", F.col("before").alias("slot"))


def balanced_shards(documents: DataFrame, shards: int = 8, rounds: int = 8, salts: int = 256,
                    buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `documents` (doc_id, text).

    Law `rows`: the shards' row counts differ by one at most; slots run from 0 without gaps in every shard. A null text
    counts as empty: size 1, crc32 0, and linked with empty texts. Repeated rows and equal or null ids give a row each.
    An empty table gives an empty result. Other columns are not read.
    """
    if salts % shards:
        raise ValueError("salts must be a multiple of shards")
    text = F.coalesce("text", F.lit(""))
    base = staged(documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), _bucket(F.struct("doc_id"), salts).cast("int").alias("salt")))
    atoms = staged(base.groupBy("digest", "salt").agg(F.count("*").alias("n")))
    total = atoms.agg(F.sum("n")).first()[0] or 0
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    linked = atoms.groupBy("digest").agg(F.sum("n").alias("members")).where("members > 1")
    homes = staged(atoms.join(linked, "digest").groupBy("digest", "members", (F.col("salt") % shards).alias("shard"))
                   .agg(F.sum("n").alias("n")))
    # groups that fit a shard come first; those that must be cut anyway share the room behind them. What exceeds a quota
    # in the end leaves it and is placed like an unlinked document
    fits = F.col("members") <= max(1, min(quotas))
    small = _within(propagate(homes.where(fits).drop("members"), quotas, rounds, buckets), quotas, buckets)
    small = staged(small)
    behind = _held(small, shards)
    left = [q - h for q, h in zip(quotas, behind, strict=True)]
    large = _within(propagate(homes.where(~fits).drop("members"), left, rounds, buckets), left, buckets)
    kept = small.union(large.withColumn("slot", F.col("slot") + _by_shard(behind)))
    within = Window.partitionBy("digest").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    kept = staged(kept.withColumn("low", F.coalesce(F.sum("n").over(within), F.lit(0))))
    places = kept.groupBy("digest").agg(F.collect_list(F.struct("low", "n", "shard", "slot")).alias("places"))

    earlier = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    located = (atoms.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
               .join(places, "digest").select("digest", "salt", "start", "places"))
    order = Window.partitionBy("digest", "salt").orderBy("doc_id")
    placed = (base.join(located, ["digest", "salt"], "left")
              .withColumn("at", F.row_number().over(order) - 1 + F.col("start"))
              .withColumn("place", F.get(F.filter(
                  "places", lambda p: (F.col("at") >= p["low"]) & (F.col("at") < p["low"] + p["n"])), F.lit(0))))
    placed = staged(placed.select(
        "doc_id", "size", "text_crc32", F.col("place.shard").cast("int").alias("shard"),
        (F.col("place.slot") + F.col("at") - F.col("place.low")).alias("slot")))

    held = _held(kept, shards)
    free = placed.where("shard is null").select("doc_id", "size", "text_crc32", F.lit(1).alias("one"))
    free = _running(free, "one", [], ["doc_id", "size", "text_crc32"], buckets)
    shard, slot, end = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        begin, end = end, end + quotas[s] - held[s]
        here = (F.col("before") >= begin) & (F.col("before") < end)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("before") - begin + held[s]).otherwise(slot)
    filled = free.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
    every = placed.where("shard is not null").union(filled)
    return every.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
