"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Method. Equal vectors are one node. Nodes start with the best of some random
buckets as neighbours. Then, round after round, every node tells each of its
neighbours about itself; whoever is told of several nodes compares all of these
with each other (they are neighbours of neighbours) and sends to each the ones
that beat its worst neighbour. A round is two exchanges, by the node told and by
the node improved; it ends when few lists change. A query begins at the list of
its own node, visits the best nodes that it hasn't visited, keeps the best of
what is listed there, and goes on until its beam has no unvisited node. What is
in the beam at last is scored in double precision on the original vectors.

Scale. Graph and walk use vectors of one byte a component, relative to the
largest one of all, and a bounded number of lists a node (the nearest ones; rows
beyond are dropped before the exchange by the limit of a ranked window), of
entries a list and of nodes a beam, which grow as the logarithm of the number of
vectors; so no group grows with the data, and nothing but counts and one number
reach the driver. The walk joins beams with packed lists by plain equi-joins,
whose large partitions adaptive execution can split. Rounds are written to the
shared folder and older ones deleted.

Defined cases. Vectors that are null, of no component, zero, or that hold a null
or non-finite component take no part, neither do null ids and vectors of another
length than most have (ties: the shortest). Of rows with one id the smallest
vector counts, so repeated rows count once. Ties go to the smaller id. Of equal
vectors the LIMIT + 1 smallest ids are kept, all that an answer can hold; every
one of them that is a query has its answer. An empty table, or a query without
candidates, gives no rows. Further columns are never looked at.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.tables import drop, written
from sketchloom.llm.textkit import limit_batches, tidy

#: Neighbours that a node keeps, and nodes that one is told of in a round.
LISTED, DEGREE = 48, 64
#: Lists that suffice for so many vectors don't for more: they get so many entries more for each doubling, others in proportion.
ENOUGH, MORE = 1 << 16, 6
#: Of the nodes that one is told of, so many are sent on to each other one.
SENT = 6
#: Random buckets that every node is in at first, and their size.
BUCKETS, BUCKET = 8, 256
#: Rounds end when under this part of the lists' entries is new, or after so many.
CHANGED, ROUNDS = 0.05, 16
#: Best nodes that a query keeps, that it visits at a time, and how often.
BEAM, VISITS, WALKS = 112, 64, 6
#: Copies of a vector are first cut down in so many parts.
SALTS = 32
#: Groups that one numpy step compares.
_STEP = 256

_SENT = "a bigint, code binary, ids array<bigint>, scores array<float>"
_NODE = "id bigint, code binary, ids array<bigint>, scores array<float>, fresh int"


def _encoded(vectors: np.ndarray) -> np.ndarray:
    """A byte a component and a float for the scale, a row for each vector."""
    scale = (np.abs(vectors).max(axis=1) / 127).astype(np.float32)
    scale = np.where(scale > 0, scale, np.float32(1))
    codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    return np.concatenate([codes.view(np.uint8), scale[:, None].view(np.uint8)], axis=1)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-4].copy().view(np.int8).astype(np.float32) * codes[:, -4:].copy().view(np.float32)


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[start[0] : start[-1]].reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has (null: none)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches in batches of about ``most`` rows, cut only where the key changes."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield from table.slice(0, end).combine_chunks().to_batches()
        rest = table.slice(end)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]])


def _compared(sent: int):
    """Rows (at, id, code, worst) in order of ``at``: each id gets the best of those it shares ``at`` with, if they beat its worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "at"):
            ids, worst = batch.column("id").to_numpy(), batch.column("worst").to_numpy().astype(np.float32)
            vectors = _decoded(_bytes(batch.column("code")))
            bounds = _edges(batch.column("at").to_numpy())
            # groups of like size stand together, so that little is filled up
            order = np.argsort(np.diff(bounds), kind="stable")
            sizes = np.diff(bounds)[order]
            at = int(np.searchsorted(sizes, 2))
            while at < len(order):
                to = min(at + _STEP, len(order))
                to = min(to, at + max(1, (1 << 20) // int(sizes[to - 1]) ** 2))
                some, wide = order[at:to], int(sizes[to - 1])
                place = np.minimum(bounds[some][:, None] + np.arange(wide), len(ids) - 1)
                real = np.arange(wide) < sizes[at:to, None]
                at = to
                block = np.where(real[:, :, None], vectors[place], np.float32(0))
                scores = block @ block.transpose(0, 2, 1)
                scores[~np.broadcast_to(real[:, None, :], scores.shape)] = -np.inf
                scores[:, np.arange(wide), np.arange(wide)] = -np.inf
                flat, rows = scores.reshape(-1, wide), place.ravel()
                take = min(sent, wide - 1)
                best = np.argpartition(-flat, take - 1, axis=1)[:, :take]
                found = np.take_along_axis(flat, best, axis=1)
                row, col = np.nonzero((found > worst[rows][:, None]) & real.ravel()[:, None] & (found > -np.inf))
                if not len(row):
                    continue
                whom, other = ids[rows[row]], ids[place[row // wide, best[row, col]]]
                turn = np.argsort(whom, kind="stable")
                cut = _edges(whom[turn])
                n = np.diff(cut)
                yield pa.RecordBatch.from_arrays([pa.array(whom[turn][cut[:-1]]), pa.nulls(len(n), pa.binary()), _lists(other[turn], n, pa.int64()), _lists(found[row, col][turn], n, pa.float32())], ["a", "code", "ids", "scores"])

    return run


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, marks: np.ndarray | None = None):
    """Of the (id, score) of each owner the ``most`` best ones, each id once: owner, id, score[, mark] in order of owner and score. Of a repeated id the first one stays."""
    order = np.lexsort((np.arange(len(ids)), ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    once = np.ones(len(ids), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    marks = marks[order][once] if marks is not None else None
    owner, ids, scores = owner[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0)) if len(owner) else np.zeros(0, np.int64)
    keep = rank < most
    return owner[keep], ids[keep], scores[keep], (marks[order][keep] if marks is not None else None)


def _among(owner: np.ndarray, ids: np.ndarray, of: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of the distinct pairs (owner, id) are among the pairs (of, those)."""
    o, i, given = np.concatenate([of, owner]), np.concatenate([those, ids]), np.repeat([0, 1], [len(of), len(owner)])
    order = np.lexsort((given, i, o))
    o, i = o[order], i[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (i[1:] == i[:-1])
    out = np.zeros(len(o), bool)
    out[order] = same
    return out[len(of) :]


def _merged(most: int):
    """Rows (a, code, ids, scores) in order of a, of which one has the code and is the node as it was: the node with the best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "a"):
            a = batch.column("a").to_numpy()
            node = np.flatnonzero(~batch.column("code").is_null().to_numpy(zero_copy_only=False))
            names, code = a[node], batch.column("code").take(pa.array(node))
            ids, n = _flat(batch.column("ids"), np.int64)
            scores, _ = _flat(batch.column("scores"), np.float32)
            owner = np.repeat(np.searchsorted(names, a), n)
            old = np.repeat(~batch.column("code").is_null().to_numpy(zero_copy_only=False), n)
            order = np.argsort(~old, kind="stable")  # an entry that was there stays as it is
            owner, ids, scores, was = _best(owner[order], ids[order], scores[order], most, old[order])
            n = np.bincount(owner, minlength=len(names))
            fresh = np.bincount(owner, weights=~was, minlength=len(names)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(names), code, _lists(ids, n, pa.int64()), _lists(scores, n, pa.float32()), pa.array(fresh)], ["id", "code", "ids", "scores", "fresh"])

    return run


def _codes(peak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(_encoded(values / peak))], ["id", "code"])

    return run


def _told(nodes: DataFrame, listed: int, degree: int) -> DataFrame:
    """(at, id, code, worst): every node at itself and at each of its neighbours, the nearest ``degree`` and itself at each."""
    worst = F.when(F.size("ids") < listed, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1)).cast("float")
    own = F.array(F.struct(F.col("id").alias("at"), F.lit(float("inf")).cast("float").alias("score")))
    places = F.concat(own, F.zip_with("ids", "scores", lambda i, s: F.struct(i.alias("at"), s.alias("score"))))
    rows = nodes.select("id", "code", worst.alias("worst"), F.explode(places).alias("p")).select(F.col("p.at").alias("at"), F.col("p.score").alias("score"), "id", "code", "worst")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= degree + 1)
    return ranked.select("at", "id", "code", "worst")


def _joined(nodes: DataFrame, pairs: DataFrame, listed: int) -> DataFrame:
    both = nodes.select(F.col("id").alias("a"), "code", "ids", "scores").union(pairs)
    return both.repartition("a").sortWithinPartitions("a").mapInArrow(tidy(_merged(listed)), _NODE)


def sizes(count: int) -> dict[str, int]:
    """``listed``, ``degree`` and ``beam`` for so many vectors: up to ENOUGH the same, then growing as the logarithm does, so that recall needn't fall."""
    listed = LISTED + (MORE * math.ceil(math.log2(count / ENOUGH)) if count > ENOUGH else 0)
    return {"listed": listed, "degree": DEGREE * listed // LISTED, "beam": BEAM * listed // LISTED}


class _Table:
    """A written table that replaces the one before it, whose files and exchanges are let go."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.path, self.name = *written(df, name), name

    def put(self, df: DataFrame) -> None:
        spark, old = self.df.sparkSession, self.path
        self.df, self.path = written(df, self.name)
        drop(spark, old)
        del df
        # Spark deletes the files of exchanges whose plans have been collected, and a small driver seldom collects
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        drop(self.df.sparkSession, self.path)


def build_graph(codes: DataFrame, count: int, *, listed: int = LISTED, degree: int = DEGREE, sent: int = SENT, changed: float = CHANGED, rounds: int = ROUNDS) -> _Table:
    """NN-descent over (id, code): a table (id, code, ids, scores, fresh), the neighbours of each node from the best on."""
    buckets = max(1, count // BUCKET)
    drawn = F.array(*[F.lit(i * buckets) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(buckets)) for i in range(BUCKETS)])
    start = codes.select(F.explode(drawn).alias("at"), "id", "code", F.lit(float("-inf")).cast("float").alias("worst"))
    # a bucket is random and so about as large as asked; larger ones are cut by further bits
    start = start.repartition("at").sortWithinPartitions("at").mapInArrow(tidy(_compared(2 * sent)), _SENT)
    empty = codes.select("id", "code", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("scores"))
    nodes = _Table(_joined(empty, start, listed), "neighbours")
    for _ in range(rounds):
        pairs = _told(nodes.df, listed, degree).mapInArrow(tidy(_compared(sent)), _SENT)
        nodes.put(_joined(nodes.df, pairs, listed))
        fresh, entries = nodes.df.agg(F.sum("fresh"), F.sum(F.size("ids"))).first()
        if not entries or fresh <= changed * entries:
            break
    return nodes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, ids, codes): who is listed at a node, its codes end to end."""
    for batch in grouped(batches, "at"):
        bounds = _edges(batch.column("at").to_numpy())
        codes = _bytes(batch.column("code"))
        where = pa.py_buffer((bounds * codes.shape[1]).astype(np.int32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, where, pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("at").take(pa.array(bounds[:-1])), _lists(batch.column("id").to_numpy(), np.diff(bounds), pa.int64()), packed], ["at", "ids", "codes"])


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, asked, worst, ids, codes), a visit each: what is listed there and beats the worst of the beam."""
    for batch in batches:
        if not batch.num_rows:
            continue
        asked, worst = _decoded(_bytes(batch.column("asked"))), batch.column("worst").to_numpy()
        ids, n = _flat(batch.column("ids"), np.int64)
        packed = batch.column("codes")
        start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        codes = np.frombuffer(packed.buffers()[2], np.uint8)[start[0] : start[-1]].reshape(len(ids), -1)
        row = np.repeat(np.arange(len(n)), n)
        scores = np.concatenate([_decoded(codes[at : at + (1 << 16)]) for at in range(0, len(codes), 1 << 16)] or [np.zeros((0, 1), np.float32)])
        scores = np.einsum("ij,ij->i", scores, asked[row])
        good = scores > worst[row]
        counts = np.bincount(row[good], minlength=len(n))
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.nulls(len(n), pa.binary()), _lists(ids[good], counts, pa.int64()), _lists(scores[good], counts, pa.float32()), pa.nulls(len(n), pa.list_(pa.int64()))], ["a", "code", "ids", "scores", "seen"])


def _beams(most: int, visits: int):
    """Rows (a, code, ids, scores, seen) in order of a: the beam of each query and which nodes it visits next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "a"):
            a = batch.column("a").to_numpy()
            node = np.flatnonzero(~batch.column("code").is_null().to_numpy(zero_copy_only=False))
            names = a[node]
            ids, n = _flat(batch.column("ids"), np.int64)
            scores, _ = _flat(batch.column("scores"), np.float32)
            owner = np.repeat(np.searchsorted(names, a), n)
            other = ids != names[owner]
            owner, ids, scores, _ = _best(owner[other], ids[other], scores[other], most)
            seen, m = _flat(batch.column("seen").take(pa.array(node)), np.int64)
            new = ~_among(owner, ids, np.repeat(np.arange(len(names)), m), seen)
            # the best of the new ones, as beams are in order
            so_far = np.concatenate([[0], np.cumsum(new)])
            pick = new & (so_far[1:] - 1 - so_far[np.searchsorted(owner, owner)] < visits)
            n_next = np.bincount(owner[pick], minlength=len(names))
            both = np.concatenate([np.repeat(np.arange(len(names)), m), owner[pick]])
            order = np.argsort(both, kind="stable")
            n = np.bincount(owner, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), batch.column("code").take(pa.array(node)), _lists(ids, n, pa.int64()), _lists(scores, n, pa.float32()), _lists(np.concatenate([seen, ids[pick]])[order], m + n_next, pa.int64()), _lists(ids[pick], n_next, pa.int64())],
                ["a", "code", "ids", "scores", "seen", "next"],
            )

    return run


def walk(nodes: DataFrame, asked: DataFrame, *, listed: int = LISTED, degree: int = DEGREE, beam: int = BEAM, visits: int = VISITS, walks: int = WALKS) -> _Table:
    """Greedy search from the lists of the nodes ``asked`` (id): a table (a, code, ids, scores, seen, next) of their beams."""
    lists, lists_at = written(_told(nodes, listed, degree).select("at", "id", "code").mapInArrow(tidy(_packed), "at bigint, ids array<bigint>, codes binary"), "lists")
    schema = "a bigint, code binary, ids array<bigint>, scores array<float>, seen array<bigint>"
    begun = nodes.join(asked, "id", "left_semi").select(F.col("id").alias("a"), "code", "ids", "scores", F.array("id").alias("seen"))
    step = lambda rows: rows.repartition("a").sortWithinPartitions("a").mapInArrow(tidy(_beams(beam, visits)), schema + ", next array<bigint>")
    state = _Table(step(begun), "beams")
    first = None
    for _ in range(walks):
        left = state.df.agg(F.sum(F.size("next"))).first()[0] or 0
        first = first or left
        # a walk that a hundredth of the first visits is left of has ended for nearly all
        if not left or left * 100 < first:
            break
        worst = F.when(F.size("ids") < beam, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1)).cast("float")
        gone = state.df.select("a", F.col("code").alias("asked"), worst.alias("worst"), F.explode("next").alias("at"))
        found = gone.join(lists, "at").select("a", "asked", "worst", "ids", "codes").mapInArrow(tidy(_visited), schema)
        state.put(step(state.df.select("a", "code", "ids", "scores", "seen").union(found)))
    drop(nodes.sparkSession, lists_at)
    return state


def _valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vector): usable vectors in double precision, one for each id."""
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    # -0.0 is 0.0
    return rows.select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def nearest(df: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", limit: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``limit`` nearest that the search finds for each row where ``is_query`` (of column ``id``) holds."""
    spark = df.sparkSession
    limit_batches(spark)
    rows, rows_at = written(_valid(df, vec_id, embedding).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")}), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    most_common = [r["n"] for r in lengths.collect()]
    rows = rows.filter(F.size("vector") == (most_common[0] if most_common else 0))
    # of equal vectors the smallest ids, in two steps, as there may be very many
    ranked = lambda d, *keys: d.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= limit + 1).drop("r")
    few = ranked(ranked(rows.select("h", "g", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "h", "g", "salt"), "h", "g")
    classes = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("node", F.get("members", F.lit(0)))
    classes, classes_at = written(classes, "classes")
    vectors, vectors_at = written(rows.select("id", "vector").join(classes.select(F.col("node").alias("id"), "members"), "id"), "nodes")
    peak = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    codes, codes_at = written(vectors.select("id", "vector").mapInArrow(tidy(_codes(peak)), "id bigint, code binary"), "codes")
    queries = rows.filter(is_query).select(F.col("id").alias("query_id"), "h", "g").join(classes.select("h", "g", F.col("node").alias("a")), ["h", "g"]).select("query_id", "a")
    queries, queries_at = written(queries, "queries")
    count = codes.count()
    size = sizes(count)
    graph = build_graph(codes, count, listed=size["listed"], degree=size["degree"])
    beams = walk(graph.df, queries.select(F.col("a").alias("id")).distinct(), **size)
    # the query's own node is a candidate of other queries with that vector
    pairs = beams.df.select("a", F.explode(F.concat(F.array("a"), "ids")).alias("id"))
    both = pairs.join(vectors, "id").join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("asked")), "a")
    score = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = both.select("a", score.alias("score"), "members").select("a", F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("id"))).alias("some"))
    tops = found.groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, limit + 1).alias("top"))
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, limit)
    answers = queries.join(tops, "a").select("query_id", F.posexplode(others).alias("at", "t"))
    answers, _ = written(answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.s")).alias("score")), "nearest")
    for path in (rows_at, classes_at, vectors_at, codes_at, queries_at):
        drop(spark, path)
    graph.drop()
    beams.drop()
    return answers
