"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key seeds a 64-bit linear congruential sequence; each draw jumps to a later shard
until the jump passes the shard count. The shard depends on the key and the count alone, there
is no ring table, and one more shard takes rows only into itself (1 / (n + 1) of them).

Edge cases: a null key hashes as null (one fixed shard); repeated rows get a slot each; an empty
table gives an empty result; extra columns of the input are not used by ``shard_manifest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Multiplier of the published 64-bit generator, split into three limbs of
# 22, 22 and 20 bits (products of limbs stay below 2**45, so ANSI arithmetic never overflows).
_MULT = 2862933555777941757
_M0, _M1, _M2 = _MULT & 0x3FFFFF, (_MULT >> 22) & 0x3FFFFF, _MULT >> 44
_MASK22, _MASK20 = 0x3FFFFF, 0xFFFFF
#: Steps taken before the (rarely needed) rest of at most ``n`` steps.
FIRST_STEPS = 24


def _limbs(seed: Column) -> list[Column]:
    return [seed.bitwiseAND(F.lit(_MASK22)),
            F.shiftrightunsigned(seed, 22).bitwiseAND(F.lit(_MASK22)),
            F.shiftrightunsigned(seed, 44)]


def _next_limbs(k0: Column, k1: Column, k2: Column) -> Column:
    a = k0 * F.lit(_M0) + F.lit(1)
    b = k0 * F.lit(_M1) + k1 * F.lit(_M0) + F.shiftright(a, 22)
    c = k0 * F.lit(_M2) + k1 * F.lit(_M1) + k2 * F.lit(_M0) + F.shiftright(b, 22)
    return F.struct(a.bitwiseAND(F.lit(_MASK22)).alias("k0"), b.bitwiseAND(F.lit(_MASK22)).alias("k1"),
                    c.bitwiseAND(F.lit(_MASK20)).alias("k2"))


def _step(n: int):
    def step(s: Column, _i: Column) -> Column:
        k = _next_limbs(s["k0"], s["k1"], s["k2"])
        # the top 31 bits of the new state, as the draw in (0, 1]
        draw = (F.shiftleft(k["k2"], 11).bitwiseOR(F.shiftright(k["k1"], 11)) + F.lit(1)).cast("double") / F.lit(float(1 << 31))
        jump = F.floor((s["b"] + F.lit(1)).cast("double") / draw)
        moved = F.struct(k["k0"].alias("k0"), k["k1"].alias("k1"), k["k2"].alias("k2"),
                         jump.alias("b"), s["b"].alias("last"))
        return F.when(s["b"] < F.lit(n), moved).otherwise(s)
    return step


def jump_hash(seed: Column, n_shards: int) -> Column:
    """Shard 0 .. n_shards - 1 of a 64-bit seed (an int Column)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    k0, k1, k2 = _limbs(seed)
    zero = F.lit(0).cast("long")
    state = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), zero.alias("b"), (zero - 1).alias("last"))
    step = _step(n_shards)
    # every jump moves forward, so n_shards steps always suffice; most keys need about ln(n)
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(n_shards, FIRST_STEPS))), state, step)
    if n_shards <= FIRST_STEPS:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), state, step, lambda s: s["last"].cast("int"))
    rest = F.aggregate(F.sequence(F.lit(FIRST_STEPS + 1), F.lit(n_shards)), first, step)
    return F.when(first["b"] >= n_shards, first["last"]).otherwise(rest["last"]).cast("int")


def key_seed(*keys: Column) -> Column:
    """64-bit seed of a stable key (any columns)."""
    return F.xxhash64(*keys)


def assign_shards(df: DataFrame, keys: list[str], n_shards: int, out: str = "shard") -> DataFrame:
    """``df`` with its shard: a projection, no shuffle; all columns pass through."""
    return df.withColumn(out, jump_hash(key_seed(*[F.col(k) for k in keys]), n_shards))


#: Slot numbering deals each shard over this many cells (a fixed number: 8 shards give 8192 cells).
CELLS = 1024


def shard_manifest(df: DataFrame, keys: list[str], carry: list[str], n_shards: int, cells: int = CELLS) -> DataFrame:
    """One row per input row: ``keys``, ``carry``, ``shard``, ``grown_shard`` (with one more shard) and
    ``slot``, numbered without gaps from 0 in each shard.

    Equal rows are counted before the shuffle and unfolded after numbering, so a key that fills a
    third of the table is one counted row per task; numbering runs per (shard, cell) with cell
    offsets from a table of n_shards * cells counts. Slots follow (cell, columns), whatever the
    partitioning of the input.
    """
    cols = list(dict.fromkeys([*keys, *carry]))
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    seed = key_seed(*[F.col(k) for k in keys])
    placed = (counted.withColumn("shard", jump_hash(seed, n_shards))
              .withColumn("grown_shard", jump_hash(seed, n_shards + 1))
              .withColumn("__cell", F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit("cell")), F.lit(cells)).cast("int")))
    per_cell = placed.groupBy("shard", "__cell").agg(F.sum("__n").alias("__cell_n"))
    before = W.partitionBy("shard").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_cell.select("shard", "__cell", F.coalesce(F.sum("__cell_n").over(before), F.lit(0)).alias("__off"))
    inside = (W.partitionBy("shard", "__cell").orderBy(*[F.col(c).asc_nulls_first() for c in cols])
              .rowsBetween(W.unboundedPreceding, -1))
    numbered = (placed.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
                .join(offsets, ["shard", "__cell"]))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    return (numbered.select(*cols, "shard", "grown_shard", "__off", "__in", copies.alias("__i"))
            .select(*cols, "shard", "grown_shard", (F.col("__off") + F.col("__in") + F.col("__i")).alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int = 8, carry: list[str] | None = None) -> DataFrame:
    """Documents sharded by ``doc_id``: doc_id, size (UTF-8 bytes of the text, null as none, plus 1),
    text_crc32, law, shard, slot, grown_shard and any ``carry`` columns."""
    narrow = docs.select(
        "doc_id", *[c for c in carry or []],
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"))
    out = shard_manifest(narrow, ["doc_id"], [*(carry or []), "size", "text_crc32"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *(carry or []))
