"""Resharding by minimum-cost flow.

Old shard sizes and new capacities make a transport problem of shards x shards cells, solved on the driver. The flow is
carried out with blocks: each old shard is dealt into a fixed number of blocks by a hash of the row, whole blocks follow
the flow, and only the few blocks in which two destinations meet are cut between rows. Affected files are rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.common import shared_path

#: Blocks of an old shard: at least BLOCKS, of about BLOCK_BYTES, at most MOST_BLOCKS, which bounds the block table.
BLOCKS, MOST_BLOCKS, BLOCK_BYTES = 1024, 1 << 16, 64_000_000
_OWN = ["shard", "shard_old", "shard_block", "shard_size", "shard_new", "shard_crc", "shard_from", "shard_until", "shard_at"]


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """Units to move from each old shard to each new one; staying costs nothing, any other move 1 a unit.

    Successive cheapest augmenting paths (Bellman-Ford on the residual network); total supply must fit the capacity.
    """
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = float("inf")
        cost_old = [0 if x else far for x in left]
        cost_new, via_new, via_old = [far] * n, [-1] * n, [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    price = 0 if i == j else 1
                    if cost_old[i] + price < cost_new[j]:
                        cost_new[j], via_new[j], changed = cost_old[i] + price, i, True
                    if flow[i][j] and cost_new[j] - price < cost_old[i]:
                        cost_old[i], via_old[i], changed = cost_new[j] - price, j, True
        end = min((j for j in range(n) if room[j]), key=lambda j: cost_new[j])
        path, j = [], end
        while True:
            i = via_new[j]
            path.append((i, j, 1))
            if via_old[i] < 0:
                break
            j = via_old[i]
            path.append((i, j, -1))
        most = min([left[i], room[end], *(flow[a][b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a][b] += way * most
        left[i] -= most
        room[end] -= most
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _deal(sizes: dict[tuple[int, int], int], flow: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
    """(old, block, from byte, to byte, new shard): the blocks of each old shard in turn fill its destinations, own shard first."""
    out = []
    for old, row in enumerate(flow):
        ways = sorted(((j != old, j, x) for j, x in enumerate(row) if x), key=lambda w: w[:2])
        at, room = 0, ways[0][2] if ways else 0
        for block in sorted(b for o, b in sizes if o == old):
            begin, rest = 0, sizes[old, block]
            while rest > room and at + 1 < len(ways):
                if room:
                    out.append((old, block, begin, begin + room, ways[at][1]))
                begin, rest, at = begin + room, rest - room, at + 1
                room = ways[at][2]
            out.append((old, block, begin, 2**62, ways[at][1]))
            room -= rest
    return out


def _plain(docs: DataFrame, old_shard: Column, name: str) -> DataFrame:
    """The documents with the old shard as column `name` (null is shard 0) and without columns named like the results."""
    return docs.withColumn(name, F.coalesce(old_shard.cast("int"), F.lit(0))).drop(*[c for c in _OWN if c != name])


def _blocks(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    return docs.withColumns({"shard_size": size, "shard_crc": crc, "shard_block": F.pmod(F.xxhash64(F.col(doc_id), crc), F.lit(blocks)).cast("int")})


def reshard(docs: DataFrame, old_shard: Column, old_shards: int = 8, new_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[list[int]]]:
    """The documents with shard_old, shard_block, shard_size and shard_new, and the flow in bytes.

    A row's size is its text's UTF-8 bytes plus 1, null text none. New shards hold near equal bytes: a cut falls between
    two rows, so a shard is off by at most the rows at its cuts. A null identifier is ordered first, a null old shard is
    shard 0; rows that repeat are rows of their own. An empty table gives an empty result. Other columns pass through, but
    for those named like the results (`shard` or with `shard_` in front), which are replaced.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1)).first()[0] or 0
    base = _blocks(_plain(docs, old_shard, "shard_old"), doc_id, text, min(MOST_BLOCKS, max(BLOCKS, int(total // old_shards // BLOCK_BYTES))))
    sizes = {(r[0], r[1]): r[2] for r in base.groupBy("shard_old", "shard_block").agg(F.sum("shard_size")).collect()}  # at most old_shards * MOST_BLOCKS rows
    supply = [sum(v for (o, _), v in sizes.items() if o == k) for k in range(old_shards)]
    flow = cheapest_flow(supply, even_capacities(sum(supply), new_shards))
    deal = _deal(sizes, flow)
    spark = docs.sparkSession
    count: dict[tuple[int, int], int] = {}
    for o, b, *_ in deal:
        count[o, b] = count.get((o, b), 0) + 1
    schema = "shard_old int, shard_block int, shard_from long, shard_until long, shard_new int"
    place = ["shard_old", "shard_block"]
    whole = spark.createDataFrame([x for x in deal if count[x[0], x[1]] == 1], schema).drop("shard_from", "shard_until")
    cut = spark.createDataFrame([x for x in deal if count[x[0], x[1]] > 1], schema)
    # Both tables are bounded by shards and MOST_BLOCKS.
    stay = base.join(F.broadcast(whole), place)
    order = Window.partitionBy(*place).orderBy(doc_id, "shard_crc", "shard_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = base.join(F.broadcast(cut.select(*place).distinct()), place, "left_semi").withColumn("shard_at", F.sum("shard_size").over(order) - F.col("shard_size"))
    split = running.join(F.broadcast(cut), place).filter("shard_at >= shard_from AND shard_at < shard_until").drop("shard_from", "shard_until", "shard_at")
    return stay.unionByName(split).drop("shard_crc"), flow


def affected(flow: list[list[int]]) -> list[int]:
    """Shards whose files change: those that give or get bytes."""
    return sorted({k for i, row in enumerate(flow) for j, x in enumerate(row) if x and i != j for k in (i, j)})


def write_shards(dealt: DataFrame, path: str, shards: Sequence[int]) -> None:
    """Write the files of the given new shards; no other's rows are written."""
    rows = dealt.filter(F.col("shard_new").isin([int(x) for x in shards]))
    rows.withColumn("shard", F.col("shard_new")).drop("shard_new", "shard_size").write.mode("append").partitionBy("shard").parquet(path)


def with_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """slot: gapless number from 0 within a shard. Rows are numbered inside blocks, in parallel; a small table has where each block begins."""
    small = rows.groupBy("shard", "shard_old", "shard_block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = Window.partitionBy("shard").orderBy("shard_old", "shard_block")
    begins = small.withColumn("begin", F.sum("block_rows").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("block_rows")).drop("block_rows")
    inside = Window.partitionBy("shard", "shard_old", "shard_block").orderBy(*order)
    numbered = rows.withColumn("slot_in", F.row_number().over(inside) - 1)
    return numbered.join(begins, ["shard", "shard_old", "shard_block"]).withColumn("slot", (F.col("begin") + F.col("slot_in")).cast("long")).drop("begin", "slot_in")


def reshard_files(docs: DataFrame, old_shard: Column, old_shards: int = 8, new_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the old shards as files, then write anew only the shards that the flow affects, and read the new layout.

    The files of shards that neither give nor get bytes stay as they are and are read where they are. The result has the
    columns of `docs`, shard_old, shard_block and shard; what `reshard` says of other cases holds here too.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "shards")
    first = _plain(docs, old_shard, "shard")
    first.write.partitionBy("shard").parquet(f"{path}/old")
    fields = [f for f in first.schema.fields if f.name != "shard"]
    number = lambda name: T.StructField(name, T.IntegerType())
    old = spark.read.schema(T.StructType([*fields, number("shard")])).parquet(f"{path}/old")
    dealt, flow = reshard(old, F.col("shard"), old_shards, new_shards, doc_id, text)
    touched = affected(flow)
    write_shards(dealt, f"{path}/new", touched)
    written = spark.read.schema(T.StructType([*fields, number("shard_old"), number("shard_block"), number("shard")])).parquet(f"{path}/new")
    untouched = old.filter(~F.col("shard").isin(touched)) if touched else old
    # No block of an untouched shard is cut, so one number does for its rows' place.
    kept = _blocks(untouched, doc_id, text, BLOCKS).withColumn("shard_old", F.col("shard"))
    return written.unionByName(kept.select(*written.columns))
