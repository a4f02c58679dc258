"""Sharding by a permutation-filled lookup table.

Each shard has a preference order of the table's slots, a permutation made from two digests of its name
(offset and step modulo the prime table size).  Shards take turns; on its turn a shard claims the first free
slot of its order, until all slots are taken.  A record's key is digested to a slot, and a broadcast
of the table (one row a slot) places it.  When a shard goes, few records of the others move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 6553
#: Slots of a shard's order looked at in one step of the fill.
WINDOW = 64


def _digest(text: Column) -> Column:
    """The first 32 bits of a string's MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: the owner of each of ``slots`` (a prime above the number of shards), shards numbered from 0.

    A fold over turns in one row: the state holds the owners, the shard whose turn it is, and each
    shard's place in its order.  The table is bounded by ``slots`` and does not grow with data.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or not _is_prime(slots) or slots <= len(names):
        raise ValueError("slots must be a prime number above the number of shards, and there must be a shard")
    k = len(names)
    listed = F.array(*[F.lit(n) for n in names])
    orders = spark.range(1).select(
        F.transform(listed, lambda n: F.pmod(_digest(F.concat(n, F.lit("#offset"))), F.lit(slots)).cast("int")).alias("offsets"),
        F.transform(listed, lambda n: (F.pmod(_digest(F.concat(n, F.lit("#step"))), F.lit(slots - 1)) + 1).cast("int")).alias("steps"),
    )

    owners, places = (lambda state: state["owners"]), (lambda state: state["places"])

    def put(values: Column, i: Column, value: Column) -> Column:
        return F.concat(F.slice(values, F.lit(1), i), F.array(value), F.slice(values, i + 2, F.size(values)))

    # owners lie in rows of about the table's square root, so that a claim copies two short lists and not the table
    side = math.isqrt(slots - 1) + 1
    row = lambda slot: F.floor(slot / side).cast("int")

    def claim(rows: Column, slot: Column, shard: Column) -> Column:
        return put(rows, row(slot), put(F.get(rows, row(slot)), slot % side, shard))

    def turn(state: Column, _: Column) -> Column:
        """Look at the next WINDOW slots of the shard's order: claim the first free one, or move on and stay on turn."""
        shard = state["claimed"] % k
        at = F.get(places(state), shard)
        slot = lambda j: ((F.get(F.col("offsets"), shard) + j.cast("bigint") * F.get(F.col("steps"), shard)) % slots).cast("int")
        ahead = F.transform(F.sequence(at, at + WINDOW - 1), lambda j: F.get(F.get(owners(state), row(slot(j))), slot(j) % side))
        step = F.array_position(ahead, F.lit(-1)).cast("int")  # from 1; 0 if none is free
        return F.when(state["claimed"] >= slots, state).otherwise(
            # a one-element list binds the step, so that it is looked up once
            F.get(
                F.transform(
                    F.array(step),
                    lambda s: F.struct(
                        F.when(s > 0, claim(owners(state), slot(at + s - 1), shard)).otherwise(owners(state)).alias("owners"),
                        put(places(state), shard, at + F.when(s > 0, s).otherwise(F.lit(WINDOW))).alias("places"),
                        F.when(s > 0, state["claimed"] + 1).otherwise(state["claimed"]).alias("claimed"),
                    ),
                ),
                0,
            )
        )

    start = F.struct(F.array_repeat(F.array_repeat(F.lit(-1), side), side).alias("owners"), F.array_repeat(F.lit(0), k).alias("places"), F.lit(0).alias("claimed"))
    turns = F.sequence(F.lit(1), F.lit(slots + k * -(-slots // WINDOW)))
    filled = orders.select(F.aggregate(turns, start, turn, lambda s: F.slice(F.flatten(owners(s)), 1, slots)).alias("owners"))
    # posexplode() would add a filter on the list's size, and so fill the table twice
    return filled.select(F.posexplode_outer("owners").alias("slot", "shard"))


def place(docs: DataFrame, shards: list[str] | int = SHARDS, slots: int = SLOTS, key: Column | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` by ``key`` (default: ``doc_id`` as text).

    Cases: a null key counts as the empty string; equal keys share a shard, however many they are; repeated rows stay; null, empty and
    very long texts are passed on as they are; columns of the input named ``slot`` or ``shard`` are replaced; an empty table gives no rows.
    """
    key = F.coalesce((F.col("doc_id") if key is None else key).cast("string"), F.lit(""))
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots))
    keyed = docs.drop("slot", "shard").withColumn("slot", F.pmod(_digest(key), F.lit(slots)).cast("int"))
    return keyed.join(table, "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str] | int = SHARDS, slots: int = SLOTS, key: Column | None = None, files: int = 4) -> None:
    """Write ``docs`` as one folder a shard, each dealt over ``files`` tasks, so that a shard with a hot key is not one task's work."""
    placed = place(docs, shards, slots, key)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c not in ("slot", "shard")]), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


#: The same in DuckDB SQL: the fill as a recursive query, a row a claim.
PLACE_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT i AS shard,
         CAST('0x' || substr(md5('shard-' || i || '#offset'), 1, 8) AS BIGINT) % {SLOTS} AS first_slot,
         CAST('0x' || substr(md5('shard-' || i || '#step'), 1, 8) AS BIGINT) % {SLOTS - 1} + 1 AS step
  FROM range({SHARDS}) t(i)
), orders AS (
  SELECT list(first_slot ORDER BY shard) AS firsts, list(step ORDER BY shard) AS steps FROM prefs
), fill AS (
  SELECT 0 AS claimed, -1::BIGINT AS slot, [0::BIGINT for _ in range({SLOTS})] AS taken FROM orders
  UNION ALL
  SELECT claimed + 1, next_slot, list_concat(taken[:next_slot], [1::BIGINT], taken[next_slot + 2:])
  FROM (
    SELECT claimed, taken,
           list_filter([(firsts[claimed % {SHARDS} + 1] + j * steps[claimed % {SHARDS} + 1]) % {SLOTS} for j in range({SLOTS})],
                       lambda s: taken[s + 1] = 0)[1] AS next_slot
    FROM fill, orders WHERE claimed < {SLOTS}
  )
), slots AS (
  SELECT CAST(slot AS INTEGER) AS slot, CAST((claimed - 1) % {SHARDS} AS INTEGER) AS shard FROM fill WHERE claimed > 0
)
SELECT d.doc_id, s.slot, s.shard, CAST(octet_length(encode(coalesce(d.text, ''))) AS BIGINT) AS n_bytes
FROM documents d JOIN slots s
  ON s.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SLOTS}
"""
