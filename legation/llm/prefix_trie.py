"""Prefix trie of conversations.

A turn is the 16-byte digest of its role and text, a conversation the string
of its turns' digests. Conversations are sorted by that string and cut into
ranges; each task builds an adaptive radix tree (path compression, nodes of 4,
16, 48 or 256 children) over its range and emits a node per whole turn. A node
whose subtree lies inside one range is final there. The others are prefixes of
a range's first or last string (the *edges*, two paths per range): their parts
are added up, and what lies below them is summed along the paths.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legation.llm.common import cut, text_of

ID = 16  # bytes of a turn id
FAMILY = 20  # conversations c - c % FAMILY lend their first turns
MOST_LENT = 3
RANGE_ROWS = 100_000  # conversations of one range
CHUNK = 512  # ids in a row of an edge node's members
NOTHING = hashlib.sha256(b"").hexdigest()
LAYOUTS = (4, 16, 48, 256)


class Node:
    """A node of the radix tree; ``path`` are the bytes between its parent and itself."""

    __slots__ = ("path", "layout", "keys", "kids", "members")

    def __init__(self, path: bytes) -> None:
        self.path, self.layout = path, 4
        self.keys: bytearray | None = bytearray()  # up to 16: the children's bytes; 48: a slot per byte; 256: none
        self.kids: list[Node | None] = []
        self.members: array | None = None

    def find(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.kids[byte]
        if self.layout == 48:
            slot = self.keys[byte]
            return self.kids[slot - 1] if slot else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, child: Node) -> None:
        """Set the child of ``byte``, moving to the next layout when this one is full."""
        if self.layout == 256:
            self.kids[byte] = child
            return
        if self.layout == 48:
            if slot := self.keys[byte]:
                self.kids[slot - 1] = child
                return
        elif (at := self.keys.find(byte)) >= 0:
            self.kids[at] = child
            return
        if len(self.kids) == self.layout:
            self._grow()
            self.put(byte, child)
            return
        self.kids.append(child)
        if self.layout == 48:
            self.keys[byte] = len(self.kids)
        else:
            self.keys.append(byte)

    def _grow(self) -> None:
        old = list(self.children())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.keys = bytearray(256)
            for i, child in enumerate(old):
                self.keys[child.path[0]] = i + 1
        elif self.layout == 256:
            self.keys, self.kids = None, [None] * 256
            for child in old:
                self.kids[child.path[0]] = child

    def children(self) -> Iterator[Node]:
        return (kid for kid in self.kids if kid is not None)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def insert(root: Node, key: bytes, member: int) -> None:
    node, at = root, 0
    while at < len(key):
        child = node.find(key[at])
        if child is None:
            child = Node(key[at:])
            node.put(key[at], child)
            node = child
            break
        if not key.startswith(child.path, at):
            shared = common(child.path, key[at : at + len(child.path)])
            upper = Node(child.path[:shared])
            child.path = child.path[shared:]
            upper.put(child.path[0], child)
            node.put(key[at], upper)
            child = upper
        node, at = child, at + len(child.path)
    if node.members is None:
        node.members = array("q")
    node.members.append(member)


def joined(members: array) -> bytes:
    return ",".join(map(str, members)).encode()


class Emitter:
    """The rows of one range: final nodes, the nodes of its two edge paths, the members that end at edges."""

    FIELDS = {
        "kind": pa.int32(), "path": pa.int64(), "depth": pa.int64(), "node": pa.binary(), "parent": pa.binary(),
        "conv": pa.int64(), "parent_conv": pa.int64(), "n": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(),
        "saved": pa.int64(), "words": pa.int64(), "ends": pa.string(),
    }
    SQL = (
        "kind int, path long, depth long, node binary, parent binary, conv long, parent_conv long, n long, kids long, "
        "leaves long, saved long, words long, ends string"
    )
    FINAL, EDGE, MEMBERS = range(3)

    def __init__(self) -> None:
        self.rows: list[list] = []

    def add(self, *row) -> int:
        self.rows.append(list(row))
        return len(self.rows) - 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.rows), 10_000):
            columns = list(zip(*self.rows[start : start + 10_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, self.FIELDS.values())], names=list(self.FIELDS)
            )


def prefix_digests(key: bytes) -> list[bytes]:
    """A digest of every whole-turn prefix, the empty one first."""
    state = hashlib.sha256()
    out = [state.digest()]
    for at in range(0, len(key), ID):
        state.update(key[at : at + ID])
        out.append(state.digest())
    return out


def emit(root: Node, first: bytes, last: bytes, words: dict[bytes, int], part: int) -> Emitter:
    """Walk the tree bottom up; every whole-turn depth on a path is a node."""
    out = Emitter()
    digests = prefix_digests(first), prefix_digests(last)
    both = common(first, last) // ID  # the paths share the nodes up to this depth
    key = bytearray()
    FROM, ROWS, N, LOW, HEADS, LEAVES, SAVED, EDGE = range(2, 10)

    def frame(node: Node, edge: tuple[int, int]) -> list:
        start = len(key)
        key.extend(node.path)
        edge = tuple(
            start + common(node.path, whole[start : start + len(node.path)]) if reach == start else reach
            for reach, whole in zip(edge, (first, last))
        )
        return [node, node.children(), start, out.rows, 0, None, [], 0, 0, edge]

    stack = [frame(root, (0, 0))]
    while True:
        top = stack[-1]
        child = next(top[1], None)
        if child is not None:
            stack.append(frame(child, top[EDGE]))
            continue
        node, start, end, reach = top[0], top[FROM], len(key), top[EDGE]
        n, low, heads, leaves, saved = top[N], top[LOW], top[HEADS], top[LEAVES], top[SAVED]
        if node.members:
            n += len(node.members)
            low = node.members[0] if low is None else min(low, node.members[0])
        depths = range(end - end % ID, start, -ID) if end else (0,)
        for at in depths:
            depth, count = at // ID, words[bytes(key[at - ID : at])] if at else 0
            members = node.members if at == end else None
            if at <= max(reach):
                side = 0 if at <= reach[0] else 1
                digest = digests[side][depth]
                for row in heads:
                    out.rows[row][4] = digest
                out.add(
                    out.EDGE, 2 * part + side, depth, digest, digests[side][depth - 1] if depth else None,
                    low, None, n, len(heads), leaves, saved, count, None,
                )
                for i in range(0, len(members or ()), CHUNK):
                    some = members[i : i + CHUNK]
                    out.add(out.MEMBERS, 2 * part, depth, digest, None, some[0], *[None] * 6, joined(some).decode())
                heads, leaves, saved = [], 0, 0
                continue
            for row in heads:
                out.rows[row][6] = low
            saved += (n - 1) * count
            leaves = leaves or 1
            sha = hashlib.sha256(joined(members)).hexdigest() if members else NOTHING
            heads = [out.add(out.FINAL, None, depth, None, None, low, None, n, len(heads), leaves, saved, count, sha)]
        del key[start:]
        stack.pop()
        if not stack:
            break
        above = stack[-1]
        above[N] += n
        above[LOW] = low if above[LOW] is None else min(above[LOW], low)
        above[HEADS] = above[HEADS] + heads if len(heads) < len(above[HEADS]) else heads + above[HEADS]
        above[LEAVES] += leaves
        above[SAVED] += saved
    if len(digests[1]) > both + 1:  # the second path runs through the shared nodes too, which the first has counted
        for depth in range(both + 1):
            digest, parent = digests[1][depth], digests[1][depth - 1] if depth else None
            out.add(out.EDGE, 2 * part + 1, depth, digest, parent, None, None, 0, 0, 0, 0, None, None)
    return out


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``key, words, conv`` rows of one range to the rows of its tree."""
    root, words = Node(b""), {}
    first = last = None
    for batch in batches:
        for ids, counts, conv in zip(*(column.to_pylist() for column in batch.columns)):
            key = b"".join(ids)
            words.update(zip(ids, counts))
            first = key if first is None else first
            last = key
            insert(root, key, conv)
    if first is not None:
        yield from emit(root, first, last, words, TaskContext.get().partitionId()).batches()


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, which arrive in order; holds one state."""
    node = state = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends"]
        )

    for batch in batches:
        for key, chunk in zip(*(column.to_pylist() for column in batch.columns)):
            if key != node:
                if state is not None:
                    yield row()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.encode())
    if state is not None:
        yield row()


def turn_id(role: Column, text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the role's length, the role and the text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, ID)


def rebuilt(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv, key, words``: every conversation's turn ids and word counts, after its first turns are lent.

    A conversation c takes its first h turns from c - c % 20, h = crc32 of its
    decimal id modulo 4, and goes on with its own turns after its first h.
    """
    role, text = text_of(role_col), text_of(text_col)
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        turn_id(role, text).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own"))
    own = cut(own.select("conv", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("own")))
    lender = own.filter(F.col("conv") % FAMILY == 0).select(
        F.col("conv").alias("family"), F.slice("own", 1, MOST_LENT).alias("head")
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_LENT + 1)).cast("int")
    both = own.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", h).join(lender, "family", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.lit(1), F.lit(0)))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = both.select("conv", F.concat(head, tail).alias("turns"))
    return whole.select("conv", F.col("turns.id").alias("key"), F.col("turns.words").alias("words"))


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per distinct prefix of whole turns of the rebuilt conversations.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. Turns are ordered by number, null first; turns with one
    number by their digest; repeated rows are turns of their own. Null role or
    text is empty. Rows without a conversation id belong to none and are left
    out. An empty table gives no rows. Other columns are ignored.
    """
    convs = cut(rebuilt(conversations, conv_col, turn_col, role_col, text_col))
    spark = convs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // RANGE_ROWS))
    ranges = convs.select("key", "words", "conv").repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
    rows = cut(ranges.mapInArrow(_range_rows, Emitter.SQL))

    paths = rows.filter(f"kind = {Emitter.EDGE}")
    merged = paths.groupBy("node").agg(
        F.min("path").alias("owner"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"),
    )
    edge_kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("edge_kids"))
    edges = merged.join(edge_kids, "node", "left").withColumn("kids", F.col("kids") + F.coalesce("edge_kids", F.lit(0)))
    edges = cut(
        edges.withColumn("leaves", F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")))
        .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
    )
    # What a node has below it along a path; every node counts on the path that owns it.
    mine = F.col("path") == F.col("owner")
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    sums = (
        paths.select("path", "node").join(edges.select("node", "owner", "depth", "leaves", "saved"), "node")
        .select(
            "node",
            F.sum(F.when(mine, F.col("leaves")).otherwise(0)).over(below).alias("leaves"),
            F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(below).alias("saved"),
        )
        .groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    chunks = rows.filter(f"kind = {Emitter.MEMBERS}").select("node", "conv", "ends")
    ends = (
        chunks.repartition("node").sortWithinPartitions("node", "conv").select("node", "ends")
        .mapInArrow(_digest_runs, "node binary, ends string")
    )
    above = edges.select(F.col("node").alias("parent"), F.col("conv").alias("edge_conv"))
    of_edges = (
        edges.drop("leaves", "saved").join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
        .select("conv", "depth", F.col("edge_conv").alias("parent_conv"), "n", "kids", "leaves", "saved",
                F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
    )
    final = rows.filter(f"kind = {Emitter.FINAL}").join(above, "parent", "left").select(
        "conv", "depth", F.coalesce("parent_conv", "edge_conv").alias("parent_conv"), "n", "kids", "leaves", "saved", "ends"
    )
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return final.unionByName(of_edges).toDF(*names)
