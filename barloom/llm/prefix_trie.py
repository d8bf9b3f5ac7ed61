"""Operator 12, the prefix trie of conversations from their sorted neighbours.

A conversation is the sequence of its turns' digests, so sequences sorted as
bytes have all members of a trie node side by side, and a node is an interval of
sequences with the depth of their common prefix.  Sorted neighbours are edges,
as deep as their common prefix is long.  Union-find takes them in descending
depth: every merge of two components creates (or widens) the branching node at
this depth.  The nodes between two branching ones have the same members and are
read off the edge that joins them.

Sequences are dealt by ranges of (sequence, conv_id), so that copies of one
conversation, however many, lie in several partitions.  Each partition builds
its own forest.  Its nodes on the common prefix with a neighbouring partition
are parts of nodes that go on there; parts carry sums that add up (a node's
own term counts only in the first partition that has it) and are merged by node.
All other nodes are complete.

Turns are ordered by turn (null first), then role, then text; null role or text
is empty.  A conversation is rebuilt from the first turns of another one by
``rebuilt``.  Rows without a conv_id belong to no conversation and are left out.
Very long texts only leave their digest and length in a sequence, of 20 bytes a
turn.  Repeated rows are turns of their own.  Further columns are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, materialise, places

#: Bytes of a turn's digest.
WIDE = 16
#: Conversations come in hundreds with a common beginning of up to five turns.
BLOCK, HEADS = 100, 6

NODE = pa.schema(
    [("node", pa.binary()), ("up", pa.binary()), ("part", pa.int64()), ("open", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())]
)
SCHEMA = "node binary, up binary, part long, open boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Rows of a batch that a partition gives.
BATCH = 20_000


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its turns' digests end to end, and their lengths in code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    # turns of one conversation may lie in several partitions: each gives a piece, and pieces are put together by partition
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    short = sorted_.select("conv_id", digest.alias("digest"), F.char_length("text").alias("chars"), F.spark_partition_id().alias("part"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []

        def piece(conv, part, digests, chars):
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(digests, pa.binary()), pa.array(chars, pa.binary())], names=["conv_id", "part", "digests", "chars"])

        for batch in batches:
            if not batch.num_rows:
                continue
            convs, part = batch.column("conv_id").to_numpy(), batch.column("part")[0].as_py()
            digests, chars = batch.column("digest").to_pylist(), batch.column("chars").to_numpy().astype(np.int32)
            starts = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]]))
            ends = np.append(starts[1:], len(convs))
            made = [(int(convs[a]), part, [b"".join(digests[a:b])], [chars[a:b].tobytes()]) for a, b in zip(starts, ends, strict=True)]
            if kept and kept[0][0] == made[0][0]:
                kept[0][2].extend(made[0][2])
                kept[0][3].extend(made[0][3])
                made = made[1:]
            made = kept + made
            kept, made = made[-1:], made[:-1]
            if made:
                yield piece([m[0] for m in made], [m[1] for m in made], [b"".join(m[2]) for m in made], [b"".join(m[3]) for m in made])
        if kept:
            yield piece([kept[0][0]], [kept[0][1]], [b"".join(kept[0][2])], [b"".join(kept[0][3])])

    pieces = short.mapInArrow(fold, "conv_id long, part int, digests binary, chars binary")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "digests", "chars"))).alias("of"))
    joined = lambda c: F.aggregate(F.col("of"), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x[c]))
    return materialise(whole.select("conv_id", joined("digests").alias("digests"), joined("chars").alias("chars")), "turns")


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of its block's first conversation."""
    none = F.lit(b"").cast("binary")
    base = convs.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), *[F.substring(c, 1, (HEADS - 1) * w).alias(f"base_{c}") for c, w in (("digests", WIDE), ("chars", 4))])
    both = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BLOCK, "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")}).join(base, "base", "left")
    own = lambda c, w: F.substring(F.col(c), F.col("h") * w + 1, F.octet_length(c))
    head = lambda c, w: F.coalesce(F.substring(F.col(f"base_{c}"), F.lit(1), F.col("h") * w), none)
    return both.select("conv_id", *[F.concat(head(c, w), own(c, w)).alias(c) for c, w in (("digests", WIDE), ("chars", 4))])


def common(keys: list[bytes]) -> np.ndarray:
    """For sorted sequences, the turns that each shares with the next one."""
    n = len(keys) - 1
    out = np.zeros(max(0, n), np.int64)
    if n <= 0:
        return out
    sizes = np.array([len(k) // WIDE for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    least = np.minimum(sizes[1:], sizes[:-1])
    alive, depth = np.flatnonzero(least > 0), 0
    while len(alive):
        same = (flat[starts[alive] + depth] == flat[starts[alive + 1] + depth]).all(axis=1)
        alive = alive[same]
        depth += 1
        out[alive] = depth
        alive = alive[least[alive] > depth]
    return out


def merge(depths: list[int], edges: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Branching nodes by union-find over neighbour edges, the deepest first and then from the left.

    Takes each sequence's depth and each edge's.  Nodes 0 to n-1 are the
    sequences' ends; returns each node's depth, its parent (-1: none), and the
    first and last sequence below it.
    """
    n = len(depths)
    depth, parent, first, last = list(depths), [-1] * n, list(range(n)), list(range(n))
    group, top = list(range(n)), list(range(n))  # of a component: its representative, and its topmost node

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for e in np.argsort(-edges, kind="stable").tolist():
        d, a, b = int(edges[e]), find(e), find(e + 1)
        one, two = top[a], top[b]  # two is deeper than d: the right component has no edge of this depth yet
        at = one
        if depth[one] != d:
            at = len(depth)
            depth.append(d)
            parent.append(-1)
            first.append(first[one])
            last.append(last[one])
            parent[one] = at
        parent[two] = at
        last[at] = last[two]
        group[b] = a
        top[a] = at
    return depth, parent, first, last


def prefix_names(key: bytes, turns: int) -> list[bytes]:
    """Names of a sequence's prefixes of 0, 1, ... turns."""
    digest = hashlib.md5()
    names = [digest.digest()]
    for t in range(turns):
        digest.update(key[t * WIDE : (t + 1) * WIDE])
        names.append(digest.digest())
    return names


def forest(part: int, convs: np.ndarray, keys: list[bytes], chars: list[bytes], left: int, right: int) -> Iterator[pa.RecordBatch]:
    """All nodes of one partition's sorted sequences.

    ``left`` and ``right`` are the turns that its first and last sequence share
    with the partitions before and after it (-1: there is none).
    """
    starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
    members = np.diff([*starts, len(keys)]).tolist()
    seqs = [keys[i] for i in starts]
    depth, parent, first, last = merge([len(k) // WIDE for k in seqs], common(seqs))
    n, end = len(depth), len(seqs) - 1
    before = np.concatenate([[0], np.cumsum(members)]).tolist()
    lows = [int(convs[a : a + m].min()) for a, m in zip(starts, members, strict=True)]
    least = lows + [lows[first[v]] for v in range(len(seqs), n)]
    children, kids, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    left_names, right_names = prefix_names(seqs[0], left), prefix_names(seqs[end], right)
    rows: dict[str, list] = {name: [] for name in NODE.names}
    parents: list = []  # a node below a branching one, whose smallest member is known in the end

    def name(v: int, t: int) -> bytes | None:
        """Of a node that goes on in a neighbouring partition."""
        if first[v] == 0 and t <= left:
            return left_names[t]
        return right_names[t] if last[v] == end and t <= right else None

    for v in sorted(range(n), key=lambda v: -depth[v]):  # children first
        u, count = parent[v], before[last[v] + 1] - before[first[v]]
        above = depth[u] if u >= 0 else -1
        if not children[v] and not (last[v] == end and depth[v] <= right):
            leaves[v] += 1
        lengths = np.frombuffer(chars[starts[first[v]]], np.int32)
        run, own = saved[v], left if first[v] == 0 else -1  # nodes down to this depth count for the partition before
        for t in range(depth[v], above, -1):
            if t:
                run += (count - (t > own)) * int(lengths[t - 1])
            named = name(v, t)
            ends = b""
            if t == depth[v] and v <= end:
                ends = ",".join(map(str, np.sort(convs[starts[v] : starts[v] + members[v]]).tolist())).encode()
            of = v if t - 1 > above else u
            parents.append(of if t else None)
            values = (named, name(of, t - 1) if t else None, part, named is not None, None, t, None, count, kids[v] if t == depth[v] else int(t + 1 > own), leaves[v], run)
            for column, value in zip(NODE.names, values):
                rows[column].append(value)
            rows["conv_id"][-1] = v
            rows["ends"].append(ends.decode() if named is not None else hashlib.sha256(ends).hexdigest())
        if u >= 0:
            least[u] = min(least[u], least[v])
            children[u] += 1
            kids[u] += above + 1 > own
            leaves[u] += leaves[v]
            saved[u] += run
    rows["conv_id"] = [least[v] for v in rows["conv_id"]]
    rows["parent_conv_id"] = [None if v is None else least[v] for v in parents]
    for a in range(0, len(parents), BATCH):
        yield pa.RecordBatch.from_pydict({k: v[a : a + BATCH] for k, v in rows.items()}, NODE)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of partitions, whose rows come one partition after the other, each in order."""
    held: list[pa.RecordBatch] = []

    def built() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        part, left, right = (table.column(c)[0].as_py() for c in ("part", "left", "right"))
        yield from forest(part, table.column("conv_id").to_numpy(), table.column("digests").to_pylist(), table.column("chars").to_pylist(), left, right)

    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("part")[0].as_py() != parts[a]:
                yield from built()
                held.clear()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from built()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of nodes, which come node by node, in the partitions' order."""
    now, digest, some = None, None, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([now | {"ends_sha256": digest.hexdigest()}], MERGED)

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["node"] != row["node"]:
                if now is not None:
                    yield done()
                now, digest, some = {k: row[k] for k in MERGED.names[:-1]}, hashlib.sha256(), False
            else:
                now["conv_id"] = min(now["conv_id"], row["conv_id"])
                for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[k] += row[k]
            if row["ends"]:
                digest.update(b"," * some + row["ends"].encode())
                some = True
    if now is not None:
        yield done()


MERGED = pa.schema([("node", pa.binary()), ("up", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that a partition's last sequence shares with the next one's first."""
    for batch in batches:
        both = zip(batch.column("last").to_pylist(), batch.column("next").to_pylist(), strict=True)
        right = [-1 if b is None else int(common([a, b])[0]) for a, b in both]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(right, pa.int32())], names=["part", "right"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per trie node of (conv_id, digests, chars): see ``OUT`` for the columns."""
    dealt = places(sequences, "digests", "conv_id")
    by = Window.orderBy("part")  # a row per partition
    edges = dealt.groupBy("part").agg(F.min("digests").alias("first"), F.max("digests").alias("last")).withColumn("next", F.lead("first").over(by))
    bounds = materialise(edges.select("part", "last", "next").mapInArrow(_shared, "part int, right int"), "bounds")
    bounds = bounds.withColumn("left", F.lag("right", 1, -1).over(by))
    rows = dealt.join(F.broadcast(bounds), "part").repartition("part").sortWithinPartitions("part", "at")
    nodes = materialise(rows.select("part", "left", "right", "conv_id", "digests", "chars").mapInArrow(_forests, SCHEMA), "nodes")

    parts = nodes.where("open").select("part", *MERGED.names[:-1], "ends").repartition("node").sortWithinPartitions("node", "part")
    kind = "node binary, up binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    merged = materialise(parts.mapInArrow(_merged, kind), "merged")
    known = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.where("NOT open").withColumnRenamed("ends", "ends_sha256")
    below = keyed_join(whole.where("up IS NOT NULL").drop("parent_conv_id"), known, ["up"], "conv_id")
    again = merged.join(known, "up", "left")
    return whole.where("up IS NULL").select(OUT).unionByName(below.select(OUT)).unionByName(again.select(OUT))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with its block's first turns."""
    return prefix_trie(rebuilt(conversations(turns)))


def oracle(crc: str) -> str:
    """DuckDB SQL of the query; ``crc`` is SQL for the CRC-32 of the hex column ``h``."""
    return f"""WITH RECURSIVE t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        x AS (SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM t),
        c AS MATERIALIZED ({crc}),
        s AS MATERIALIZED (SELECT t.conv_id, list_concat(coalesce(list_slice(b.l, 1, CAST(c.crc % {HEADS} AS BIGINT)), []), list_slice(t.l, CAST(c.crc % {HEADS} AS BIGINT) + 1, len(t.l))) AS l
            FROM t JOIN c USING (conv_id) LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % {BLOCK}),
        p AS (SELECT conv_id, len(l) AS own, unnest(range(len(l) + 1)) AS depth, l FROM s),
        n AS MATERIALIZED (SELECT depth, list_slice(l, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (own = depth), '')) AS ends_sha256,
                CASE WHEN depth > 0 THEN (count(*) - 1) * length(any_value(l[depth].t)) ELSE 0 END AS saved FROM p GROUP BY 1, 2),
        k AS MATERIALIZED (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
        a AS (SELECT list_slice(path, 1, d) AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1)
        SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN a USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = list_slice(m.path, 1, m.depth - 1)"""
