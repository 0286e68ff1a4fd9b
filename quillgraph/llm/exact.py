"""Exact de-duplication by two passes over a Bloom filter, with DataFrame operations only.

The filter is cut into blocks of 32,768 positions. A hash belongs to one block and takes PROBES positions in it. The first
pass builds sparse bitmaps within partitions (a block's positions in one list), merges them by block and keeps, as a bitmap,
the positions that more than one row takes; what is exchanged is a list for each partition and block, not a row for each row.
Blocks with far more rows than others hold very frequent hashes: all their rows are suspects and need no bitmap.

The second pass probes: a row with a position that no other row takes has no equal and passes straight through; only the
others shuffle, by hash, and are settled exactly. Blocks are dealt, by a prefix of the hash, to as many filters as are needed
for each to have BLOCKS_A_FILTER blocks at most; one filter is broadcast at a time, over the rows of its prefix alone, so a
filter is as sharp for billions of rows as for a few.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quillgraph.llm.common import attach, remove, shared_dir, table

#: Positions of a block; rows that a block is made for; how many times as many make it hot; blocks of a filter (4 KB each).
WIDTH, ROWS_A_BLOCK, HOT_TIMES, BLOCKS_A_FILTER, PROBES = 1 << 15, 2048, 8, 1 << 13, 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def blocks_for(n: int) -> int:
    return max(1, -(-n // ROWS_A_BLOCK))


def block_of(key: Column, blocks: int) -> Column:
    """The key's block, from 0 on; consecutive ones make up a filter, so a filter has a range of hashes."""
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def position(key: Column, j: int) -> Column:
    """The key's j-th position in its block, from 0 on."""
    return F.pmod(F.xxhash64(key, F.lit(j)), F.lit(WIDTH)).cast("int")


def bitmaps(keys: DataFrame, key: str, blocks: int, rows: int = 1) -> DataFrame:
    """block, bitmap (4 KB) of the positions that so many of the rows take at least; a null bitmap where all are suspects."""
    placed = keys.select(block_of(F.col(key), blocks).alias("block"), *(position(F.col(key), j).alias(f"at{j}") for j in range(PROBES)))
    sized = placed.groupBy("block").agg(F.count("*").alias("n"))
    hot = table(sized.filter(F.col("n") > HOT_TIMES * ROWS_A_BLOCK).select("block"))  # a filter has 1/HOT_TIMES of its blocks at most, or few rows
    cold = placed.join(F.broadcast(hot), "block", "left_anti")
    packed = F.lit(0)
    for j in range(PROBES):
        packed = packed + F.col(f"at{j}") * F.lit(1 << 15 * j)
    lists = cold.groupBy("block").agg(F.collect_list(packed).alias("rows"))
    each = lists.select("block", F.explode("rows").alias("row"))
    at = F.array_distinct(F.array(*(F.shiftright("row", 15 * j).bitwiseAND(F.lit(WIDTH - 1)) for j in range(PROBES))))
    taken = each.select("block", F.explode(at).alias("at")).groupBy("block", "at").agg(F.count("*").alias("n")).filter(F.col("n") >= rows)
    made = taken.groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at").cast("long") + 1)).alias("bitmap"))
    return made.unionByName(hot.withColumn("bitmap", F.lit(None).cast("binary")))


def probe(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """rows as `row` with `maybe`: whether the filter has all positions of the key (true for every key that it was made of)."""
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    own = F.col(f"row.`{key}`")
    placed = held.select("row", block_of(own, blocks).alias("block"), *(position(own, j).alias(f"at{j}") for j in range(PROBES)))
    joined = placed.join(F.broadcast(filter_.select("block", "bitmap", F.lit(True).alias("known"))), "block", "left")  # BLOCKS_A_FILTER of 4 KB at most
    taken = F.coalesce("known", F.lit(False))
    for j in range(PROBES):
        bit = F.bitmap_bit_position(F.col(f"at{j}").cast("long") + 1)
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        taken = taken & F.getbit(byte, (bit % 8).cast("int")).eqNullSafe(1)
    return joined.select("row", (F.coalesce("known", F.lit(False)) & (F.col("bitmap").isNull() | taken)).alias("maybe"))


def suspects(rows: DataFrame, key: str, keys: DataFrame, n: int, least: int) -> DataFrame:
    """rows as `row` with `maybe`: false only where fewer than `least` of the n rows of keys (its column key) have the row's key.

    One filter serves up to BLOCKS_A_FILTER * ROWS_A_BLOCK keys. For more, rows and keys are written by prefix (in the shared folder,
    without a shuffle) and each prefix gets a filter of its own in turn; what a filter found is written before the next.
    """
    blocks = blocks_for(n)
    if blocks <= BLOCKS_A_FILTER:
        return probe(rows, key, table(bitmaps(keys.select(key), key, blocks, least)), blocks)
    folder, filters = f"{shared_dir(rows.sparkSession)}/prefixes-{uuid.uuid4().hex}", -(-blocks // BLOCKS_A_FILTER)
    for df, name in ((rows, "rows"), (keys.select(key), "keys")):
        own = F.col(f"`{key}`") if name == "keys" else F.col(f"row.`{key}`")
        held = df if name == "keys" else df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
        held.withColumn("prefix", F.floor(block_of(own, blocks) / BLOCKS_A_FILTER)).write.partitionBy("prefix").parquet(f"{folder}/{name}")
    schemas = {"rows": StructType().add("row", rows.schema), "keys": keys.select(key).schema}
    spark, parts = rows.sparkSession, []
    for p in range(filters):
        part = {name: spark.read.schema(s.add("prefix", "long")).parquet(f"{folder}/{name}").filter(F.col("prefix") == p).drop("prefix") for name, s in ((k, StructType(v.fields)) for k, v in schemas.items())}
        found = probe(part["rows"].select("row.*"), key, table(bitmaps(part["keys"], key, blocks, least)), blocks)
        parts.append(table(found))
    remove(spark, folder)
    return reduce(DataFrame.unionByName, parts)


def orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType) and kind.typeName() not in ("variant", "interval")


def order_of(df: DataFrame, doc_id: str, of: str) -> Column:
    """What orders the rows of a group: id (null last), then the other columns; those without an order, such as maps, as JSON."""
    rest = [(F.col(f"{of}.`{f.name}`") if orderable(f.dataType) else F.to_json(F.struct(F.col(f"{of}.`{f.name}`").alias("v")))).alias(f"c{i}") for i, f in enumerate(df.schema.fields) if f.name != doc_id]
    return F.struct(F.col(f"{of}.`{doc_id}`").isNull().alias("no_id"), F.col(f"{of}.`{doc_id}`").alias("id"), *rest)


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of rows with equal texts that with the smallest doc_id stays; null ids come last, and of
    rows tied on the id (repeated rows) exactly one stays.
    """
    keys = table(df.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    n = keys.count()
    rows = suspects(keys, "text_sha256", keys, n, 2)
    alone = rows.filter("NOT maybe").select("row.doc_id", F.col("row.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "row.text_sha256")
    several = rows.filter("maybe").select("row.*")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    sized = table(several.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")))
    settled = attach(several, sized, "text_sha256", "group_size", n).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return alone.unionByName(settled)


def distinct(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all columns, whatever their names and types: rows without an equal are not shuffled.

    The row that stays is the least by (id is null, id, other columns; see order_of), found with a map-side combine, so a
    large group of copies neither meets in one task nor is joined.
    """
    hashed = df.select(F.sha2(normalised(F.col(f"`{text}`")), 256).alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
    keys = table(hashed.select("key"))
    rows = suspects(hashed, "key", keys, keys.count(), 2)
    alone = rows.filter("NOT maybe").select("row.own")
    asked = rows.filter("maybe").select("row.key", "row.own")
    kept = asked.groupBy("key").agg(F.min_by("own", order_of(df, doc_id, "own")).alias("own")).select("own")
    return alone.unionByName(kept).select(*(F.col(f"own.`{c}`").alias(c) for c in df.columns))


def absent(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows of df whose value isn't in gone (its one column; nulls match nothing). Only rows that a filter of gone suspects are shuffled."""
    value = F.col(f"`{gone.columns[0]}`")
    gone = table(gone.select(value.alias("value"), F.coalesce(value.cast("string"), F.lit("")).alias("key")))
    held = df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
    rows = suspects(held, "key", gone, gone.count(), 1)
    asked = rows.filter("maybe").select("row.own")
    stay = asked.join(gone.select("value"), F.col(f"own.`{column}`") == F.col("value"), "left_anti")
    return rows.filter("NOT maybe").select("row.own").unionByName(stay).select(*(F.col(f"own.`{c}`").alias(c) for c in df.columns))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
