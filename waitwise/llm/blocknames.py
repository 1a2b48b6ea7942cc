"""Exact duplicate groups by deterministic block naming, in DataFrame functions only.

Each text (A-Z lower-cased) is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and numbered:
equal blocks, and no others, share an integer name. Then adjacent names are paired, the distinct pairs sorted
and numbered again, until each text is one name; (rounds, last name) is its identity, free of collisions by
construction. A text of n bytes takes log2(n / BLOCK) rounds over half as many names each.

The texts are shuffled once, as distinct blocks (counted away before the shuffle, so a block that fills a third
of the rows is one row a task). Occurrences carry a 64-bit key of their block instead of its bytes; keys whose
distinct blocks are more than one are found and their blocks are compared by their bytes, so names never rest on
the key. Joins on common names are sort-merge joins, whose hot keys Spark splits.

Edge cases: null text counts as empty (one empty block), empty texts are equal; rows with a null id take part,
a null id is smaller than any other; of rows with equal id and text one stays; an empty table gives an empty
result; other columns are not used by ``duplicate_groups`` and pass through ``keep_last``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.llm.common import ascii_lower, maybe_in, stored, union_all

#: Bytes of a block.
BLOCK = 1024
_ROW = "__row"


def normalised(text: Column) -> Column:
    """The text whose equality counts: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def blocks_of(text: Column, size: int = BLOCK) -> Column:
    """The bytes of a text in blocks of ``size``; an empty text has one empty block."""
    def cut(raw: Column) -> Column:
        n = F.greatest(F.ceil(F.octet_length(raw) / F.lit(size)), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    # bound to a lambda variable, the text is computed once and not once a block
    return F.transform(F.array(text.cast("binary")), cut)[0]


def block_key(block: Column) -> Column:
    """Where a block is looked up; names do not depend on it."""
    return F.xxhash64(block)


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows sorted inside their partitions and numbered: partition, then place in it. Stored, so that
    every reader sees the same names."""
    return stored(distinct.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name")), name)


def name_blocks(docs: DataFrame, size: int = BLOCK, key: Callable[[Column], Column] = block_key) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_sha256, n) of each document, and (row, pos, name) of its blocks."""
    text = normalised(F.col("text"))
    # the bytes of the distinct blocks: one row a block and task before the shuffle
    blocks = docs.select(F.explode(blocks_of(text, size)).alias("block")).withColumn("key", key(F.col("block"))).groupBy("key", "block").agg(F.lit(1).alias("one"))
    names = stored(blocks.sortWithinPartitions("key", "block").select("key", F.monotonically_increasing_id().alias("name")), "block-names")
    # stored, so that the joins below read a plain exchange on both sides: Spark splits hot keys of such joins only
    classes = stored(names.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")), "block-classes")
    single, shared = classes.filter("n = 1").select("key", "name"), classes.filter("n > 1").select("key")
    shared = stored(shared, "block-shared")
    # an occurrence keeps its bytes only if its key stands for several blocks
    hit = maybe_in(shared, "key", F.col("key"))
    parts = F.transform(blocks_of(F.col("t"), size), lambda b: F.struct(key(b).alias("key"), F.octet_length(b).alias("size")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("t"))
    if shared.isEmpty():
        base = stored(rows.select("row", "doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(parts, lambda x: x["key"]).alias("keys")), "block-rows")
        seen = base.select("row", F.posexplode("keys").alias("pos", "key"))
        named = seen.join(single, "key").select("row", "pos", "name")
    else:
        base = stored(rows.select("row", "doc_id", F.sha2("t", 256).alias("text_sha256"), blocks_of(F.col("t"), size).alias("keys")), "block-rows")
        seen = base.select("row", F.posexplode("keys").alias("pos", "block")).withColumn("key", key(F.col("block")))
        bytes_of = stored(seen.filter(hit).join(shared, "key", "left_semi"), "block-bytes")
        twins = _numbered(bytes_of.select("key", "block").distinct(), ["key", "block"], "block-twins")
        # names of shared keys count down from -1, so they meet no other name
        exact = bytes_of.join(twins, ["key", "block"]).select("row", "pos", (-1 - F.col("name")).alias("name"))
        named = seen.drop("block").join(single, "key").select("row", "pos", "name").unionByName(exact)
    return base.select("row", "doc_id", "text_sha256", F.size("keys").alias("n")), named


def name_documents(docs: DataFrame, size: int = BLOCK, key: Callable[[Column], Column] = block_key) -> DataFrame:
    """(row, doc_id, text_sha256, rounds, name): rows are equal texts just when (rounds, name) are equal."""
    rows, named = name_blocks(docs, size, key)
    most = rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    done = []
    for k in range(max(1, (most - 1).bit_length() + 1)):
        # the names of a document side by side, in order; documents of one name are done
        lists = stored(named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("a"))
                       .select("row", F.transform("a", lambda x: x["name"]).alias("names")), f"block-lists{k}")
        done.append(lists.filter(F.size("names") == 1).select("row", F.lit(k).alias("rounds"), F.col("names")[0].alias("name")))
        if most <= 1 << k:
            break
        pair = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / F.lit(2)).cast("int") - 1),
                           lambda i: F.struct(F.get("names", i * 2).alias("left"), F.get("names", i * 2 + 1).alias("right")))
        pairs = lists.filter(F.size("names") > 1).select("row", F.posexplode(pair).alias("pos", "p")).select("row", "pos", "p.left", "p.right")
        # a last name without a partner has the flag ``alone``, which no pair has
        pairs = pairs.select("row", "pos", "left", F.coalesce("right", F.lit(0).cast("long")).alias("right"), F.col("right").isNull().alias("alone"))
        by = ["left", "right", "alone"]
        names = _numbered(pairs.select(*by).distinct(), by, f"block-pairs{k}")
        named = pairs.join(names, by).select("row", "pos", "name")
    return rows.join(union_all(done), "row").drop("n")


def duplicate_groups(docs: DataFrame, size: int = BLOCK, key: Callable[[Column], Column] = block_key) -> DataFrame:
    """One row per document: row, doc_id, keep_id (largest doc_id among equal texts), group_size, kept (one row
    of each group), text_sha256 (of the normalised text)."""
    named = stored(name_documents(docs, size, key), "block-identities")
    groups = stored(named.groupBy("rounds", "name").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")), "block-groups")
    return named.join(groups, ["rounds", "name"]).select(
        "row", "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The documents that stay: of equal texts, the row with the largest doc_id; all columns pass through."""
    held = stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), "block-documents")
    narrow = held.select(F.struct("doc_id", _ROW).alias("doc_id"), "text")
    dropped = duplicate_groups(narrow, size).filter(~F.col("kept")).select(F.col("doc_id")[_ROW].alias(_ROW))
    return held.join(dropped, _ROW, "left_anti").drop(_ROW)
