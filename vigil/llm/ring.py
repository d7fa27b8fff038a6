"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

A row's key hashes to a position; the arc that holds it belongs to the next virtual node clockwise. A shard takes rows
up to its capacity; rows of a full shard go on clockwise to the next other shard with room. All rows of an arc share
that clockwise order of shards, so the whole placement follows from the number of rows in each arc: a table whose size
is fixed by the ring (shards x virtual nodes), whatever the data. Rows then find their shard by their rank in the arc.

Capacities add up to the number of rows and differ by one at most, so counts do too (law "rows"), while a row leaves
its home shard only where that is full. Arcs are ranges of a hash of the key, so no source, text or group of copies is
hot. Within an arc, rows are dealt to BUCKETS by a hash of the whole row and ranked there, on top of the numbers of rows in
the buckets before: rows that share a key, as null ids do, are not ranked in one task. The rank is the only shuffle of
rows, narrow ones without texts.
Null keys share a position; null texts have size 1; equal rows get different slots; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

#: Positions are 0 .. 2**60 - 1; arcs are found through 2**12 equal cells.
BITS, CELL_BITS = 60, 12
VIRTUAL_NODES = 128
#: Parts of an arc that are ranked by themselves.
BUCKETS = 16


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literal rows, made by the SQL engine itself."""
    names = T.StructType.fromDDL(schema).names
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), T.ArrayType(T.StructType.fromDDL(schema)))).alias("x")).select("x.*")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; a shard's nodes don't depend on the other shards."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - BITS)
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place(counts: list[int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard, slot of the first) pieces. counts: rows of each arc."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, done = [0] * shards, [0] * len(nodes)
    order = []
    for a in range(len(nodes)):
        seen: list[int] = []
        for i in range(len(nodes)):
            s = nodes[(a + i) % len(nodes)][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        order.append(seen)
    pieces = []
    for step in range(shards):
        for a in range(len(nodes)):
            if done[a] < counts[a] and (n := min(counts[a] - done[a], room[s := order[a][step]] - filled[s])) > 0:
                pieces.append((a, done[a], done[a] + n, s, filled[s]))
                done[a] += n
                filled[s] += n
    return pieces


def with_arc(rows: DataFrame, key: str, nodes: list[tuple[int, int]]) -> DataFrame:
    """rows with _position and _arc (index of the next virtual node clockwise)."""
    spark, wide = rows.sparkSession, BITS - CELL_BITS
    at = [p for p, _ in nodes]
    cells = []
    for c in range(1 << CELL_BITS):
        i, j = bisect.bisect_left(at, c << wide), bisect.bisect_left(at, (c + 1) << wide)
        cells.append((c, i, at[i:j]))
    cell = small_table(spark, cells, "_cell long, _first int, _inside array<long>")
    position = F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)
    return (
        rows.withColumn("_position", position)
        .withColumn("_cell", F.shiftright("_position", wide).cast("long"))
        .join(F.broadcast(cell), "_cell")  # 2**CELL_BITS rows, fixed
        .withColumn("_arc", (F.col("_first") + F.size(F.filter("_inside", lambda p: p < F.col("_position")))) % F.lit(len(nodes)))
        .drop("_cell", "_first", "_inside")
    )


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in each shard), home (the shard of the arc)."""
    spark, nodes = docs.sparkSession, ring(shards, virtual_nodes)
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = written(with_arc(narrow, key, nodes).withColumn("_bucket", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(BUCKETS)).cast("int")), "ring")
    found = written(rows.groupBy("_arc", "_bucket").count(), "arcs")  # BUCKETS rows for each arc at most
    before = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.select(F.col("_arc").alias("_oa"), F.col("_bucket").alias("_ob"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    counts = [0] * len(nodes)
    for r in found.groupBy("_arc").agg(F.sum("count").alias("n")).collect():  # one row for each arc at most
        counts[r["_arc"]] = r["n"]
    pieces = [(*p, nodes[p[0]][1]) for p in place(counts, nodes, shards)]
    ranked = rows.selectExpr("*", f"row_number() OVER (PARTITION BY _arc, _bucket ORDER BY _position, `{key}`, size, text_crc32) - 1 AS _in")
    ranked = ranked.join(F.broadcast(offsets), (F.col("_arc") == F.col("_oa")) & (F.col("_bucket") == F.col("_ob"))).withColumn("_rank", F.col("_before") + F.col("_in"))
    table = small_table(spark, pieces, "_a int, _from long, _to long, shard int, _slot long, home int")
    on = (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(table), on).select(  # a few rows for each arc
        key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"), "home"
    )
