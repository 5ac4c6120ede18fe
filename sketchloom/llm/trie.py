"""The trie of conversation prefixes: how many conversations begin alike, and what sharing these beginnings saves.

Method. A turn is 16 bytes that stand for its role and text; a conversation is
the string of its turns. All strings are sorted in ranges over the cluster, ties
by id. A pass over each range takes the longest common prefix of each string
with the one before it, in whole turns; a prefix shared by a stretch of strings
is a node, and a stack of the open ones is swept along: where the common prefix
gets shorter, nodes are complete.

Nodes that hold a range's first or last string may go on in the ranges beside
it. Their parts are put together afterwards by the prefix: all figures are sums
or minima over strings, taken so that what depends on a neighbouring string
(whether a node begins or a leaf ends here) is settled when the ends of the
ranges are known. That is one row a range, with the common prefixes of
neighbouring ends.

Scale. One exchange for turns by conversation, one for the sort by range, and
small ones for the parts. Texts are hashed before any exchange. Equal
conversations, however many, are dealt to ranges by id. A pass holds a stack of
one conversation's length and at most PENDING complete children of each open
node; more are written with their parent's name and find its smallest member by
a join. The members that end in one node are digested in order, one after the
other, from one piece a range. One conversation is one row of 24 bytes a turn.

Defined cases. Null roles and texts are empty; null turns come first; of equal
turns the order is that of the turns' digests. Rows without a conversation's id
take no part. A conversation without turns is a member of the root. An empty
table has no node. Further columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.tables import drop, written
from sketchloom.llm.textkit import limit_batches, tidy

#: Bytes that stand for a turn.
_WIDE = 16
#: Complete children of an open node that are kept until it is complete, and rows of a batch.
PENDING, _ROWS = 10_000, 10_000
_EMPTY = hashlib.sha256(b"").hexdigest()

_FIELDS = [
    ("kind", pa.int8()), ("part", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("left", pa.bool_()), ("right", pa.bool_()), ("before", pa.int64()), ("key", pa.binary()), ("last", pa.binary()), ("totals", pa.list_(pa.int64())),
]
_SCHEMA = "kind tinyint, part int, name binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, left boolean, right boolean, before bigint, key binary, last binary, totals array<bigint>"
_REST = (None,) * 6
#: Kinds of rows: a complete node, a part of one that may go on elsewhere, and a range's first and last string.
NODE, PART, RANGE = 0, 1, 2


class _Open:
    """A node on the stack."""

    __slots__ = ("depth", "before", "size", "least", "n", "children", "leaves", "saved", "ends", "first", "pending", "shared", "name")

    def __init__(self, depth: int, before: int, size: int, first: bool):
        self.depth, self.before, self.size, self.first = depth, before, size, first  # before: code points of the turns above it
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.pending: list[tuple] = []
        self.shared, self.name = first, b""


def _common(a: bytes, b: bytes) -> int:
    """Whole turns that two strings begin with alike."""
    n = min(len(a), len(b)) // _WIDE * _WIDE
    if a[:n] == b[:n]:
        return n // _WIDE
    differ = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(differ.argmax()) // _WIDE


class _Sweep:
    """One range's pass."""

    def __init__(self, part: int):
        self.part, self.rows = part, []
        self.stack: list[_Open] = []
        self.last, self.first_key, self.first_sizes = b"", None, None

    def _share(self, node: _Open) -> None:
        """From now on a node's parts are put together by its name, and its children give that as their parent."""
        if not node.shared or not node.name:
            node.shared, node.name = True, hashlib.blake2b(self.last[: node.depth * _WIDE], digest_size=_WIDE).digest()
        self.rows.extend((NODE, self.part, None, node.name, *child[:2], None, *child[2:], *_REST) for child in node.pending)
        node.pending = []

    def close(self, right: bool = False) -> None:
        """Complete the top of the stack; ``right``: it may go on in the next range."""
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        node.saved += (node.n - 1) * node.size
        ends = ",".join(map(str, node.ends))
        if node.shared or right:
            self._share(node)
            if above:
                self._share(above)
            self.rows.append((PART, self.part, node.name, above.name if above else None, node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, ends, node.first, right, node.before, None, None, None))
        else:
            self.rows.extend((NODE, self.part, None, None, *child[:2], node.least, *child[2:], *_REST) for child in node.pending)
            above.pending.append((node.least, node.depth, node.n, node.children, node.leaves, node.saved, hashlib.sha256(ends.encode()).hexdigest()))
            if above.shared or len(above.pending) > PENDING:
                self._share(above)
        if above:
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.n += node.n
            above.leaves += node.leaves
            above.saved += node.saved

    def add(self, key: bytes, conv_id: int, sizes: np.ndarray) -> None:
        common = -1
        if self.first_key is None:
            self.first_key, self.first_sizes = key, sizes
        else:
            common = _common(self.last, key)
            if common < len(self.stack) - 1:
                self.stack[-1].leaves += 1  # what comes next doesn't go on from the string before it
            while len(self.stack) - 1 > common:
                self.close()
        self.last = key
        for depth in range(common + 1, len(key) // _WIDE + 1):
            top = self.stack[-1] if self.stack else None
            if top:
                top.children += 1
            self.stack.append(_Open(depth, top.before + top.size if top else 0, int(sizes[depth - 1]) if depth else 0, common < 0))
        top = self.stack[-1]
        top.ends.append(conv_id)
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)

    def end(self) -> None:
        if self.first_key is None:
            return
        while self.stack:
            self.close(right=True)
        totals = np.concatenate([[0], np.cumsum(self.first_sizes)]).astype(np.int64).tolist()
        self.rows.append((RANGE, self.part, None, None, None, len(self.last) // _WIDE, *(None,) * 9, self.first_key, self.last, totals))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id, sizes) of a range in order of key and id."""
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        sizes = batch.column("sizes")
        for i, (key, conv_id) in enumerate(zip(batch.column("key"), batch.column("conv_id").to_pylist())):
            sweep.add(key.as_py(), conv_id, sizes[i].values.to_numpy(zero_copy_only=False))
            if len(sweep.rows) >= _ROWS:
                yield sweep.batch()
    sweep.end()
    if sweep.rows:
        yield sweep.batch()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the turns that its first string shares with the one before and their code points, and the turns that its last string shares with the one after; -1 turns: there is none."""
    for batch in batches:
        out = []
        for part, key, last, totals, depth, was, then in zip(*(c.to_pylist() for c in batch.columns)):
            before = -1 if was is None else _common(was, key)
            out.append((part, before, totals[max(before, 0)], depth, -1 if then is None else _common(last, then)))
        if out:
            kinds = (pa.int32(), *(pa.int64(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "shared", "shared_size", "last_depth", "goes_on"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, ends) in order of name and range: the SHA-256 of all ends of a name, comma-joined."""
    name, digest, done = None, None, []
    for batch in batches:
        for n, ends in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
            if n != name:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest = n, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if len(done) >= _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["name", "ends_sha256"])
            done = []
    if digest:
        done.append((name, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["name", "ends_sha256"])


def conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each with ``key``, 16 bytes that stand for role and text, in hex, and ``size``, the code points of the text."""
    col = lambda c: F.col(f"`{c}`")
    role_, text_ = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * _WIDE)
    turns = rows.select(col(conv_id).cast("bigint").alias("conv_id"), F.struct(col(turn).alias("turn"), key.alias("key"), F.length(text_).cast("bigint").alias("size")).alias("t")).filter("conv_id IS NOT NULL")
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def prefix_trie(convs: DataFrame, *, conv_id: str = "conv_id", turns: str = "turns") -> DataFrame:
    """The nodes of the trie over :func:`conversations`: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    limit_batches(spark)
    strings = convs.select(F.unhex(F.array_join(F.transform(f"`{turns}`", lambda t: t["key"]), "")).alias("key"), F.col(f"`{conv_id}`").alias("conv_id"), F.transform(f"`{turns}`", lambda t: t["size"]).alias("sizes"))
    ordered = strings.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept, swept_at = written(ordered.mapInArrow(tidy(_swept), _SCHEMA), "prefixes")

    # one row a range: where neighbouring ranges meet
    by_part = Window.orderBy("part")
    ranges = swept.filter(F.col("kind") == RANGE).select("part", "key", "last", "totals", "depth", F.lag("last").over(by_part).alias("was"), F.lead("key").over(by_part).alias("then"))
    met = ranges.mapInArrow(_met, "part int, shared bigint, shared_size bigint, last_depth bigint, goes_on bigint")
    parts = swept.filter(F.col("kind") == PART).join(met, "part")
    # the nodes that a range's first string shares with the one before it don't begin here, and its last string is a leaf if the next one doesn't go on from it
    goes_on = F.col("left") & (F.col("depth") <= F.col("shared"))
    saved = F.col("saved_tokens") + F.when(goes_on, F.col("shared_size") - F.col("before")).otherwise(0)
    children = F.col("n_children") - F.when(F.col("left") & (F.col("depth") < F.col("shared")), 1).otherwise(0)
    leaves = F.col("n_leaves") + F.when(F.col("right") & (F.col("goes_on") < F.col("last_depth")), 1).otherwise(0)
    whole = parts.groupBy("name").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum(children).alias("n_children"), F.sum(leaves).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    pieces = swept.filter((F.col("kind") == PART) & (F.col("ends") != "")).select("name", "part", "ends")
    digests = pieces.repartition("name").sortWithinPartitions("name", "part").mapInArrow(tidy(_digested), "name binary, ends_sha256 string")
    whole = whole.join(digests, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    whole, whole_at = written(whole, "shared_prefixes")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = swept.filter(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    named = whole.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("parent IS NOT NULL").drop("parent_conv_id").join(named, "parent")
    top = whole.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    found = nodes.filter("parent IS NULL").select(out).union(below.select(out)).union(whole.join(named, "parent").select(out)).union(top.select(out))
    found, _ = written(found, "trie")
    drop(spark, swept_at)
    drop(spark, whole_at)
    return found
