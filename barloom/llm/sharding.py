"""Operator 13, shards of near-equal bytes by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  Groups, the
heaviest first, go to the least-loaded shard (of equally loaded ones to the
lowest number); equally heavy groups come in the order of their texts' digests.

Groups of one weight are interchangeable, so the heap sees a row for each
distinct weight with the number of its groups, not the groups: their total
bounds the distinct weights by its square root.  A weight's groups go round the
shards that are lower than the others, until these are reached, so each weight
has a few runs of picks, however many groups it has.  Groups find their run by
their place among all groups (sorted by ranges, counted by partition), and
documents their group by a salted join on the digest; a third of all documents
in one group is therefore dealt to several tasks.

Defined results: a null text is the empty text (size 1) and is in its group.
Very long texts are read whole.  Rows without an id and repeated rows are
documents of their own, with a slot each; slots follow doc_id (null first) in a
shard.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, materialise, places, salted_join, text_or_empty

#: A weight with fewer groups is dealt pick by pick, one with more by runs.
SINGLE_PICKS = 64

PLAN = "weight long, first long, runs array<struct<start:long,turn:array<int>>>"


def picks(heap: list[tuple[int, int]], weight: int, count: int) -> list[tuple[int, list[int]]]:
    """Deal ``count`` groups of one weight to the heap's (load, shard) entries, changing it.

    Returns runs: from pick ``start`` on, until the next run, the shards of ``turn`` are picked in turn.
    """
    if count < SINGLE_PICKS:
        turn = []
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + weight, shard))
            turn.append(shard)
        return [(0, turn)]
    runs, done = [], 0
    heap.sort()
    while done < count:
        # the lowest shards, each picked once before the lowest one's next turn
        again = (heap[0][0] + weight, heap[0][1])
        low = [x for x in heap if x < again]
        some = count - done
        if len(low) < len(heap):
            (last, z), (other, y) = low[-1], heap[len(low)]
            rounds, rest = divmod(other - last, weight)
            rounds += 1 if rest or z < y else 0
            some = min(some, rounds * len(low))
        runs.append((done, [shard for _, shard in low]))
        full, part = divmod(some, len(low))
        heap[: len(low)] = [(load + weight * (full + (i < part)), shard) for i, (load, shard) in enumerate(low)]
        heap.sort()
        done += some
    return runs


def plan(weights: DataFrame, shards: int) -> DataFrame:
    """For each weight (weight, n groups) the runs of its picks, and how many groups are heavier; on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, first = [(0, s) for s in range(shards)], 0
        for batch in batches:
            out = []
            for weight, n in zip(batch.column("weight").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out.append({"weight": weight, "first": first, "runs": [{"start": a, "turn": t} for a, t in picks(heap, weight, n)]})
                first += n
            if out:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("turn", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_pylist(out, pa.schema([("weight", pa.int64()), ("first", pa.int64()), ("runs", kind)]))

    return materialise(weights.repartition(1).sortWithinPartitions(F.desc("weight")).mapInArrow(run, PLAN), "loads")


def by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, key (the text's digest), shard and slot."""
    text = text_or_empty()
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "sizes"
    )
    groups = places(rows.groupBy("key").agg(F.sum("size").alias("weight")), F.desc("weight"), "key")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    loads = plan(groups.groupBy("weight").agg(F.count("*").alias("n")), shards)
    ranked = groups.join(F.broadcast(starts), "part").select("key", "weight", (F.col("before") + F.col("at")).alias("place"))
    found = keyed_join(ranked, loads, ["weight"], "key").withColumn("nth", F.col("place") - F.col("first"))
    found = found.withColumn("run", F.expr("element_at(filter(runs, r -> r.start <= nth), -1)"))
    homes = found.select("key", F.expr("run.turn[CAST((nth - run.start) % size(run.turn) AS INT)]").alias("shard"))
    homes = materialise(homes, "homes")

    dealt = places(salted_join(rows, homes, ["key"], "doc_id"), "shard", F.asc_nulls_first("doc_id"), "key")
    seats = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seats = seats.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift"))
    return dealt.join(F.broadcast(seats), ["shard", "part"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def oracle(shards: int, crc: str) -> str:
    """DuckDB SQL of the query; ``crc`` is SQL for the CRC-32 of the hex column ``h``."""
    zeros = ", ".join(["0"] * shards)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents),
        g AS (SELECT sha256(t) AS key, CAST(sum(size) AS BIGINT) AS weight, any_value(hex(encode(t))) AS h FROM d GROUP BY 1),
        o AS (SELECT key, weight, h, row_number() OVER (ORDER BY weight DESC, key) AS n FROM g),
        s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([{zeros}] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS shard
            UNION ALL SELECT o.n, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.weight ELSE 0 END),
                list_position(loads, list_min(loads)) - 1 FROM s JOIN o ON o.n = s.n + 1),
        c AS MATERIALIZED ({crc})
        SELECT d.doc_id, d.size, c.crc AS text_crc32, 'bytes' AS law, CAST(s.shard AS INTEGER) AS shard,
            row_number() OVER (PARTITION BY s.shard ORDER BY d.doc_id NULLS FIRST, o.key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM d JOIN o ON o.key = sha256(d.t) JOIN s ON s.n = o.n JOIN c ON c.key = o.key"""
