"""Minimum-cost-flow resharding (operator 5).

Documents lie in old shards. Every old shard is cut into a fixed number of
blocks by a hash of its rows; sizes are summed by block, and that table, whose
length is ``shards * blocks`` whatever the input, goes to the driver. There a
minimum-cost flow from old shards (supply: bytes) to new ones (capacity: bytes)
with a cost for each byte that leaves its shard says how many bytes have to go
from where to where; whole blocks carry them out, and the files of the shards
that they leave or enter are rewritten. A document's place follows from its
block, so neither texts nor keys are moved to decide it. Equal texts share a
block and stay together, but for groups too large for near equal shards.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import Scratch, schema, table, text_or_empty

SHARDS, BLOCKS = 16, 4096
LIGHT = ("_folium_size", "_folium_crc", "_folium_old", "_folium_block")


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes sent from each old to each new shard, by successive shortest augmenting paths."""
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("new shards can't hold what old ones have")
    source, sink = m + n, m + n + 1
    graph: list[list[list]] = [[] for _ in range(m + n + 2)]

    def edge(a: int, b: int, cap: int, price: int) -> None:
        graph[a].append([b, cap, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(n):
            edge(i, m + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(m + j, sink, c, 0)
    left = sum(supply)
    while left:
        far = [None] * len(graph)
        came: list = [None] * len(graph)
        far[source], queue, queued = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k, (b, cap, price, _) in enumerate(graph[a]):
                if cap > 0 and (far[b] is None or far[a] + price < far[b]):
                    far[b], came[b] = far[a] + price, (a, k)
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        push, b = left, sink
        while b != source:
            a, k = came[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = came[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    flow = [[0] * n for _ in range(m)]
    for i in range(m):
        for b, cap, _, _ in graph[i]:
            if m <= b < m + n:
                flow[i][b - m] = supply[i] - cap
    return flow


def plan_blocks(blocks: list[tuple[int, int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, block, bytes, rows)."""
    supply = [0] * shards
    for old, _, size, _ in blocks:
        supply[old] += size
    total = sum(supply)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(shards)])
    to: dict[tuple[int, int], int] = {}
    for i in range(shards):
        mine = sorted((b for b in blocks if b[0] == i), key=lambda b: (-b[2], b[1]))
        for j in sorted((j for j in range(shards) if j != i and flow[i][j]), key=lambda j: -flow[i][j]):
            room, rest = flow[i][j], []
            for b in mine:
                if b[2] <= room:
                    to[b[:2]], room = j, room - b[2]
                else:
                    rest.append(b)
            mine = rest
        to.update({b[:2]: i for b in mine})
    # Whole blocks seldom add up to the flow: what is still uneven goes by single blocks, the best fitting ones first.
    size = [0] * shards
    at: list[list] = [[] for _ in range(shards)]
    for b in blocks:
        size[to[b[:2]]] += b[2]
        at[to[b[:2]]].append(b)
    for _ in range(4 * shards):
        high, low = max(range(shards), key=size.__getitem__), min(range(shards), key=size.__getitem__)
        gap = size[high] - size[low]
        fit = min((b for b in at[high] if b[2] < gap), key=lambda b: abs(gap - 2 * b[2]), default=None)
        if fit is None:
            break
        at[high].remove(fit), at[low].append(fit)
        size[high], size[low], to[fit[:2]] = size[high] - fit[2], size[low] + fit[2], low
    return to


def large_groups(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> list[int]:
    """CRC-32 of the texts whose copies have more than a sixteenth of a new shard's bytes together: 16 * ``shards`` at most."""
    whole = text_or_empty(text)
    groups = docs.select(F.crc32(whole.cast("binary")).alias("crc"), (F.octet_length(whole) + 1).cast("long").alias("size")).groupBy("crc", "size").agg(F.sum("size").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return sorted({r["crc"] for r in groups.where(F.col("n") > total // (16 * shards)).select("crc").collect()})


def with_blocks(docs: DataFrame, old_shard, large: list[int] = (), key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """The documents with _folium_size, _folium_crc, _folium_old and _folium_block.

    Equal texts of an old shard share a block, so they stay together, unless
    they are a large group: such a group is dealt by key.
    """
    whole = text_or_empty(text)
    placed = docs.withColumns({"_folium_size": (F.octet_length(whole) + 1).cast("long"), "_folium_crc": F.crc32(whole.cast("binary")), "_folium_old": old_shard.cast("int")})
    apart = F.when(F.col("_folium_crc").isin(list(large)), F.xxhash64(key)) if large else F.lit(None).cast("long")
    return placed.withColumn("_folium_block", F.pmod(F.xxhash64("_folium_crc", "_folium_size", apart), F.lit(blocks)).cast("int"))


def plan(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per block: _folium_old, _folium_block, _folium_new (its shard), _folium_first (the slot of its first row)."""
    sums = placed.groupBy("_folium_old", "_folium_block").agg(F.sum("_folium_size").alias("size"), F.count("*").alias("rows"))
    blocks = sorted((r["_folium_old"], r["_folium_block"], r["size"], r["rows"]) for r in sums.collect())  # shards * blocks rows at most
    to, used, rows = plan_blocks(blocks, shards), [0] * shards, []
    for old, block, _, n in blocks:
        new = to[old, block]
        rows.append((old, block, new, used[new]))
        used[new] += n
    return placed.sparkSession.createDataFrame(rows, schema("_folium_old int, _folium_block int, _folium_new int, _folium_first long"))


def reshard(docs: DataFrame, old_shard, shards: int = SHARDS, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    ``old_shard``: a column from 0 to shards - 1. A null text has size 1. Rows
    with equal keys keep a slot each; null keys come first in their block. An
    empty table gives no rows.
    """
    light = with_blocks(docs, old_shard, large_groups(docs, shards, text), key, text, blocks).select(key, *LIGHT)
    return _slots(light, plan(light, shards), key)


def _slots(light: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("_folium_old", "_folium_block").orderBy(key, "_folium_crc", "_folium_size")) - 1
    # The plan has shards * blocks rows at most, so it may be broadcast.
    out = light.withColumn("_folium_nth", nth).join(F.broadcast(moves), ["_folium_old", "_folium_block"])
    return out.select(
        key, F.col("_folium_size").alias("size"), F.col("_folium_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_folium_new").alias("shard"),
        (F.col("_folium_first") + F.col("_folium_nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_folium_old").alias("old_shard"),
    )


def rewrite(docs: DataFrame, old_shard, root: str, shards: int = SHARDS, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text", folder: str = "shard") -> tuple[list[int], DataFrame, list[int]]:
    """Writes the affected shards anew under ``root``/``folder``=N and leaves the others as they are.

    A shard that no document is left in loses its files. Every task writes what
    it reads to the files of its shards, so no text is shuffled. Returns the
    affected shards, the plan and the large groups.
    """
    spark, large = docs.sparkSession, large_groups(docs, shards, text)
    placed = with_blocks(docs, old_shard, large, key, text, blocks)
    moves = plan(placed, shards)
    changed = sorted({x for r in moves.where("_folium_old <> _folium_new").select("_folium_old", "_folium_new").distinct().collect() for x in r})
    moved = placed.join(F.broadcast(moves), ["_folium_old", "_folium_block"]).where(F.col("_folium_new").isin(changed))
    moved.select(*docs.columns, F.col("_folium_new").alias(folder)).write.partitionBy(folder).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    filled = {r[0] for r in moves.select("_folium_new").distinct().collect()}
    for empty in set(changed) - filled:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}={empty}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return changed, moves, large


def carry_out(docs: DataFrame, old_shard, shards: int = SHARDS, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """What ``reshard`` returns, told from the files: affected shards are rewritten and read back, the others stay where they are."""
    root = f"{(scratch or Scratch(docs.sparkSession, 'shards')).root}/shards"
    changed, moves, large = rewrite(docs, old_shard, root, shards, blocks, key, text, "_folium_at")
    light = with_blocks(docs, old_shard, large, key, text, blocks).select(key, *LIGHT)
    if not changed:
        return _slots(light, moves, key)
    spec = T.StructType([*docs.schema.fields, T.StructField("_folium_at", T.IntegerType())])
    back = with_blocks(docs.sparkSession.read.schema(spec).parquet(root), old_shard, large, key, text, blocks)
    # Its files say where a row is; the plan says its block's place there.
    found = back.select(key, *LIGHT).unionByName(light.where(~F.col("_folium_old").isin(changed)))
    return _slots(found, moves, key)


def op5_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old layout: by text, the first half of the shards twice as large as the second. Affected shards are rewritten and read back."""
    at = F.crc32(text_or_empty().cast("binary")) % (SHARDS * 3 // 2)
    return carry_out(table(spark, sf_dir, "documents"), F.when(at < SHARDS, at).otherwise(at - SHARDS))


QUERIES = {"op5_min_cost_flow_resharding": op5_min_cost_flow_resharding}
ORACLE_SQL: dict[str, str] = {}
