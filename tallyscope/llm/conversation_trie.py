"""Prefix trie of conversations: ternary search trees by range shard, merged along the borders of the shards."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import kept

#: Turns of a shard at most (about), what bounds the memory of its task; and at least, where Spark would make more tasks.
SHARD, LEAST = 500_000, 10_000
#: Nodes of a record batch.
BATCH = 10_000


def encoded(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: `conv`, and of its turns in order the dictionary numbers `ids` and the text bytes `sizes`.

    Turns are equal if role and text are; a null one counts as empty. They are ordered by `turn_col`, null first, turns
    with the same one by the SHA-256 of role and text; repeated rows are repeated turns. Rows without a conversation are
    left out. Texts are never shuffled: the dictionary is keyed by their SHA-256.
    """
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter(turns[conv_col].isNotNull()).select(
        turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size")
    )
    numbers = kept(rows.select("key").distinct().select(F.col("key").alias("key_"), F.monotonically_increasing_id().alias("id")))
    numbered = rows.join(numbers, F.col("key") == F.col("key_")).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "id", "size"))).alias("t"))
    return numbered.select("conv", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations of :func:`encoded` put on a shared beginning.

    Conversation c starts with the first h turns of conversation c - c % `family` (all, if it has fewer; none, if there is
    none) and goes on with its own turns after its first h, h being crc32 of c in decimal, modulo `most` + 1.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = convs.filter(F.col("conv") % family == 0).select(
        F.col("conv").alias("head"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes")
    )
    joined = convs.withColumn("h", h).join(heads, F.col("conv") - F.col("conv") % family == F.col("head"), "left")

    def put(head: str, own: str):
        before = F.slice(F.coalesce(head, F.array().cast("array<long>")), F.lit(1), F.col("h"))
        return F.concat(before, F.slice(own, F.col("h") + 1, F.size(own))).alias(own)

    return joined.select("conv", put("head_ids", "ids"), put("head_sizes", "sizes"))


class TernaryTree:
    """Sequences of numbers as a ternary search tree. Node 0 is the root; a node comes after its parent."""

    def __init__(self) -> None:
        self.key, self.low, self.mid, self.high, self.parent, self.depth, self.size = (array("q", [0]) for _ in range(7))
        self.members, self.first = array("q", [0]), array("q", [0])
        self.ends: dict[int, str] = {}

    def add(self, ids: list[int], sizes: list[int]) -> int:
        """The node of a sequence, made if need be."""
        key, low, mid, high = self.key, self.low, self.mid, self.high
        at = 0
        for x, size in zip(ids, sizes, strict=True):
            side, above, node = mid, at, mid[at]
            while node and key[node] != x:
                side, above = (low if x < key[node] else high), node
                node = side[above]
            if not node:
                node = len(key)
                for column, value in ((key, x), (low, 0), (mid, 0), (high, 0), (self.parent, at), (self.depth, self.depth[at] + 1), (self.size, size), (self.members, 0), (self.first, 0)):
                    column.append(value)
                side[above] = node
            at = node
        return at

    def fill(self, runs: list[tuple[list[int], list[int], list[int]]]) -> None:
        """Insert sorted distinct sequences with their conversations, the median first, so that the tree is balanced."""
        todo = [(0, len(runs))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                ids, sizes, convs = runs[m]
                node = self.add(ids, sizes)
                self.members[node], self.first[node] = len(convs), convs[0]
                self.ends[node] = ",".join(map(str, convs))
                todo += [(a, m), (m + 1, b)]

    def totals(self) -> tuple[array, array, array]:
        """Children, leaves and savings by node; members and smallest members become those of the subtrees."""
        n = len(self.key)
        children, leaves, saved = (array("q", bytes(8 * n)) for _ in range(3))
        members, first, parent, size, ends = self.members, self.first, self.parent, self.size, self.ends
        known = bytearray(n)
        for node in ends:
            known[node] = 1
        for node in range(n - 1, -1, -1):
            if not children[node]:
                leaves[node] = 1
            saved[node] += (members[node] - 1) * size[node]
            if node:
                up = parent[node]
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
                members[up] += members[node]
                if not known[up] or first[node] < first[up]:
                    first[up], known[up] = first[node], 1
        return children, leaves, saved

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


_SCHEMA = (
    "shard int, depth long, conv long, n_convs long, n_children long, n_leaves long, saved long, parent_conv long, ends string, "
    "digest binary, parent_digest binary, on_first boolean, on_last boolean, before long, "
    "first_ids array<long>, first_sizes array<long>, last_ids array<long>, first_leaf boolean, single boolean"
)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(n, _TYPES[x.split()[1]]) for n, x in zip(_NAMES, _SCHEMA.split(", "), strict=True)])


def _runs(batches: Iterator[pa.RecordBatch]) -> list[tuple[list[int], list[int], list[int]]]:
    """The distinct sequences of a sorted shard, with their conversations."""
    runs: list[tuple[list[int], list[int], list[int]]] = []
    for b in batches:
        for conv, ids, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if runs and runs[-1][0] == ids:
                runs[-1][2].append(conv)
            else:
                runs.append((ids, sizes, [conv]))
    return runs


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard.

    Nodes on the paths of its first and last sequence can be in other shards as well. They carry the digest of their path
    in place of final values; all others are done, but for the parent's conversation if that is such a node.
    """
    runs = _runs(batches)
    if not runs:
        return
    shard, tree = TaskContext.get().partitionId(), TernaryTree()
    tree.fill(runs)
    children, leaves, saved = tree.totals()
    first, last = (tree.path(tree.add(*runs[i][:2])) for i in (0, -1))
    digests, before = {0: b""}, {0: 0}
    for path in (first, last):
        for up, node in zip(path, path[1:], strict=False):
            digests[node] = hashlib.blake2b(digests[up] + tree.key[node].to_bytes(8, "little"), digest_size=16).digest()
            before[node] = before[up] + tree.size[up]
    on_first, on_last = set(first), set(last)
    rows: list[dict] = [
        {
            "shard": shard, "first_ids": runs[0][0], "first_sizes": runs[0][1], "last_ids": runs[-1][0],
            "first_leaf": not children[first[-1]], "single": len(runs) == 1,
        }
    ]
    for node in range(len(tree.key)):
        up, shared, ends = tree.parent[node], node in digests, tree.ends.get(node, "")
        row = {
            "shard": shard, "depth": tree.depth[node], "conv": tree.first[node], "n_convs": tree.members[node],
            "n_children": children[node], "n_leaves": leaves[node], "saved": saved[node],
            "ends": ends if shared else hashlib.sha256(ends.encode()).hexdigest(),
        }
        if shared:
            row |= {"digest": digests[node], "on_first": node in on_first, "on_last": node in on_last, "before": before[node]}
        if node and up in digests:
            row["parent_digest"] = digests[up]
        elif node:
            row["parent_conv"] = tree.first[up]
        rows.append(row)
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the parts of each digest, which follow each other; only one part is in memory."""
    now, state = None, None
    for b in batches:
        out = []
        for digest, part in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True):
            if digest == now:
                state.update(b",")
            else:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256()
            state.update(part.encode())
        yield _pairs(out)
    if state is not None:
        yield _pairs([(now, state.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.string())], ["digest_", "hash"])


def _borders(nodes: DataFrame) -> DataFrame:
    """A row per shard: how deep its first path belongs to shards before it (`common`), the bytes of that part, and whether
    the ends of its first and last path count as leaves elsewhere or not at all.

    The driver gets five small values per shard; a shard stands for up to `SHARD` turns.
    """
    pairs = nodes.filter("first_ids IS NOT NULL").selectExpr(
        "shard", "first_ids", "first_sizes", "size(last_ids) AS last_size", "first_leaf", "single", "lag(last_ids) OVER (ORDER BY shard) AS past"
    )
    agree = "array_position(zip_with(slice(first_ids, 1, size(past)), slice(past, 1, size(first_ids)), (a, b) -> a = b), false)"
    pairs = pairs.selectExpr("*", f"CASE WHEN past IS NULL THEN -1 WHEN {agree} = 0 THEN least(size(first_ids), size(past)) ELSE {agree} - 1 END AS common")
    pairs = pairs.selectExpr(
        "shard", "CAST(common AS INT) AS common", "size(first_ids) AS first_size", "last_size", "first_leaf", "single",
        "aggregate(slice(first_sizes, 1, greatest(CAST(common AS INT), 0)), 0L, (a, x) -> a + x) AS common_bytes",
    )
    shards = pairs.orderBy("shard").collect()
    out, goes_on = [], False
    for k in range(len(shards) - 1, -1, -1):
        s = shards[k]
        after = shards[k + 1] if k + 1 < len(shards) else None
        if after is None or after.common < s.last_size:
            goes_on = False
        elif after.first_size > s.last_size or not after.first_leaf:
            goes_on = True
        elif not after.single:
            goes_on = False
        # else the next shard holds nothing but this sequence, and what holds for it holds here
        copied = s.common == s.first_size and s.first_leaf
        out.append((s.shard, s.common, s.common_bytes, int(copied), int(goes_on and not (copied and s.single))))
    return nodes.sparkSession.createDataFrame(out, "shard_ int, common int, common_bytes long, copied int, goes_on int")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences: `conv` (smallest member), `depth`, `parent_conv` (null at the root),
    `n_convs`, `n_children`, `n_leaves`, `saved` and `ends` (SHA-256 of the members that end here).

    `convs`: rows of :func:`encoded`, a conversation in one row. They are range-partitioned by sequence, and equal ones by
    conversation, so copies of one conversation are spread; a shard is a ternary tree in one task. Only nodes on the
    borders of shards are grouped again. Without conversations there is no node.
    """
    convs = kept(convs)
    spark = convs.sparkSession
    total = convs.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST))
    ordered = convs.select("conv", "ids", "sizes").repartitionByRange(shards, "ids", "conv").sortWithinPartitions("ids", "conv")
    nodes = kept(ordered.mapInArrow(_shard, _SCHEMA))
    out = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inner = nodes.filter("depth IS NOT NULL AND digest IS NULL")

    # a row per shard, see _borders
    border = nodes.filter("digest IS NOT NULL").join(F.broadcast(_borders(nodes)), F.col("shard") == F.col("shard_"))
    border = border.selectExpr(
        "digest", "parent_digest", "depth", "conv", "n_convs",
        "n_children - CAST(on_first AND depth < common AS INT) AS n_children",
        "n_leaves - CAST(on_first AS INT) * copied - CAST(on_last AS INT) * goes_on AS n_leaves",
        "saved + IF(on_first AND depth <= common, common_bytes - before, 0) AS saved",
    ).groupBy("digest", "parent_digest", "depth").agg(
        F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    ends = nodes.filter("digest IS NOT NULL AND ends <> ''").select("digest", "ends", "shard").repartition("digest")
    ends = ends.sortWithinPartitions("digest", "shard").mapInArrow(_hashed, "digest_ binary, hash string")
    border = kept(
        border.join(ends, F.col("digest") == F.col("digest_"), "left")
        .withColumn("ends", F.coalesce("hash", F.sha2(F.lit(""), 256)))
        .withColumn("parent_conv", F.lit(None).cast("long"))
    )
    above = border.select(F.col("digest").alias("above"), F.col("conv").alias("above_conv"))
    open_ = inner.filter("parent_digest IS NOT NULL").select("parent_digest", *out).unionByName(border.select("parent_digest", *out))
    closed = open_.join(above, F.col("parent_digest") == F.col("above"), "left").withColumn("parent_conv", F.col("above_conv"))
    return inner.filter("parent_digest IS NULL").select(out).unionByName(closed.select(out))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are; see :func:`encoded` for their order and nulls, :func:`prefix_trie` for the rows."""
    return prefix_trie(encoded(turns, conv_col, turn_col, role_col, text_col))
