"""Line dedup by pairwise alignment.

Passages repeat anywhere in a line, so texts are first wrapped anew: a line
begins at each word whose next ``HEAD`` words hash to the minimum of a sliding
window, and the line's hash is that of its head. Where lines begin depends on
the words around alone, and any span of ``SPAN`` words holds a whole head, so
two documents that share so long a span share a line, wherever it stands.

A line that at most three documents have is rare, and its documents are paired
with each other, the later with the earlier. A line of more documents is
frequent; around it all spans of ``SPAN`` words are counted by hash, and a
document is paired with the first document that has the span too. So every
repeated span has a partner, without all pairs of a frequent line. A copy of an
earlier text has nothing to be aligned and goes whole. Each pair is aligned by
patience diff: lines that occur once in either are matched along the longest
chain that keeps their order and grown word by word into blocks, then those that
were moved; where repeated lines are left, all spans of the least length are
looked up. Blocks of ``SPAN`` words or more are deleted from the later document.

Scale: rare lines become pairs in one aggregation, from sums alone; frequent
lines and spans are counted with partial aggregation. Pairs carry 4 bytes a word
of the earlier document, and a document that many others are paired with is
salted, so no task joins more than about ``SALT`` of its pairs. Which texts are
hashed for that is decided by a bit map of ``FILTER_BITS`` bits over hashes of
their ids, the same at any size, which may let more texts pass but loses none.
Documents and what they are aligned with meet once, in id order, one document
and one partner in memory at a time.

Defined cases: words are those of lower-cased letters and digits, so case and
punctuation don't hide a repeat; null text stays null; shorter texts and rows
with a null id are left alone; texts of any length are read whole, in pieces;
rows of one id are one document in the order, of which the text with the
smallest hash stands for it towards later ones; columns named removed and
n_removed are replaced, all others kept, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sketchloom.llm.decontam import winnow
from sketchloom.llm.tables import drop, written
from sketchloom.llm.textkit import PIECE_BYTES, chunks, cuts, limit_batches, mix, raw, rolling, text_of, tidy, word_table, words_of

SPAN = 50
HEAD = 20
_TABLE = word_table()
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCK = 1 << 20


def line_hashes(words: np.ndarray, row: np.ndarray | None = None, span: int = SPAN, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin and their hashes, for 32-bit word hashes (of several rows if ``row`` is given)."""
    places, hashes = [], []
    w = span - head + 1
    step, at = _BLOCK, 0
    while at < len(words):
        lo, hi = max(0, at - span), min(len(words), at + step + span)
        grams = rolling(mix(words[lo:hi].astype(np.uint64)), head)
        if row is not None and len(grams):
            grams[row[lo : lo + len(grams)] != row[lo + head - 1 : hi]] = _NONE
        got = winnow(grams, w) + lo
        got = got[(got >= at) & (got < at + step)]
        places.append(got)
        hashes.append(grams[got - lo])
        at += step
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the words of one text, and where they start and end."""
    parts = []
    for at, to in cuts(text, _TABLE, PIECE_BYTES):
        w = words_of(text[at:to], np.array([0, to - at]), _TABLE)
        parts.append((w.hash.astype(np.uint32), w.start + at, w.end + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _same(a: np.ndarray, i: int, b: np.ndarray, j: int, step: int) -> int:
    """How many words from a[i] and b[j] on (step 1) or before them (step -1) are equal."""
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        x = a[i + done : i + done + n] if step > 0 else a[i - done - n : i - done][::-1]
        y = b[j + done : j + done + n] if step > 0 else b[j - done - n : j - done][::-1]
        apart = np.flatnonzero(x != y)
        if len(apart):
            return done + int(apart[0])
        done, size = done + n, size * 4
    return done


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, which are in the order of their firsts, whose seconds increase."""
    tails: list[int] = []
    where: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back.append(where[k - 1] if k else -1)
        tails[k : k + 1] = [j]
        where[k : k + 1] = [n]
    out, n = [], where[-1] if where else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Text:
    """A document's word hashes and lines."""

    def __init__(self, words: np.ndarray, places: np.ndarray, hashes: np.ndarray):
        self.words = words
        self.lines = list(zip(places.tolist(), hashes.tolist()))
        self.by: dict[int, list[int]] = {}
        for p, h in self.lines:
            self.by.setdefault(h, []).append(p)

    @classmethod
    def packed(cls, data: bytes) -> Text:
        """As :func:`pack` wrote it."""
        n = int.from_bytes(data[:4], "little")
        return cls(np.frombuffer(data, "<u4", offset=4 + 12 * n), np.frombuffer(data, "<u4", n, 4 + 8 * n), np.frombuffer(data, "<u8", n, 4))


def pack(words: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> bytes:
    return b"".join([len(places).to_bytes(4, "little"), hashes.astype("<u8").tobytes(), places.astype("<u4").tobytes(), words.astype("<u4").tobytes()])


def parsed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: where its words start, their hashes, where its lines begin, and the lines' hashes."""
    for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])]):
        data, offsets = raw(part.column("text"))
        if part.num_rows == 1:
            words, start, _ = word_hashes(data)
            yield start, words, *line_hashes(words)
            continue
        w = words_of(data, offsets, _TABLE)
        words = w.hash.astype(np.uint32)
        places, hashes = line_hashes(words, w.row)
        rows = np.arange(part.num_rows + 1)
        first, line = np.searchsorted(w.row, rows).tolist(), np.searchsorted(w.row[places], rows).tolist()
        for i in range(part.num_rows):
            a, b, c, d = first[i], first[i + 1], line[i], line[i + 1]
            yield w.start[a:b] - offsets[i], words[a:b], places[c:d] - a, hashes[c:d]


def align(later: Text, earlier: Text, least: int = SPAN) -> list[tuple[int, int]]:
    """Word ranges of ``later`` in common blocks of at least ``least`` words."""
    a, b = later.words, earlier.words
    if len(a) == len(b) and len(a) >= least and np.array_equal(a, b):
        return [(0, len(a))]
    shared = [(p, h) for p, h in later.lines if h in earlier.by]
    found: list[tuple[int, int]] = []
    covered = np.zeros(len(a) + 1, bool)
    grown: dict[int, int] = {}

    def grow(i: int, j: int) -> None:
        if i < grown.get(j - i, 0):  # pairs of a distance come in order: this one is in the block of the one before
            return
        lo, hi = _same(a, i, b, j, -1), _same(a, i, b, j, 1)
        grown[j - i] = i + hi
        if lo + hi >= least:
            found.append((i - lo, i + hi))
            covered[i - lo : i + hi] = True

    once = [(p, earlier.by[h][0]) for p, h in shared if len(later.by[h]) == 1 and len(earlier.by[h]) == 1]
    chain = _chain(once)
    for i, j in chain:
        grow(i, j)
    grown.clear()
    on = set(chain)
    for i, j in once:  # what was moved: pairs off the chain grow blocks of their own, which may overlap those found
        if (i, j) not in on:
            grow(i, j)
    if not covered[: len(a)].all() and any(len(later.by[h]) > 1 or len(earlier.by[h]) > 1 for _, h in shared):
        # repeated lines have no one partner: all spans of the least length are looked up at once
        spans = rolling(mix(a.astype(np.uint64)), least)
        hit = np.flatnonzero(np.isin(spans, rolling(mix(b.astype(np.uint64)), least)))
        if len(hit):
            first = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
            found += [(int(hit[i]), int(hit[j]) + least) for i, j in zip(first, np.append(first[1:], len(hit)) - 1)]
    return found


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        data, offsets = raw(batch.column("text"))
        if batch.num_rows == 1:
            words, _, _ = word_hashes(data)
            row = np.zeros(len(words), np.int64)
        else:
            w = words_of(data, offsets, _TABLE)
            words, row = w.hash.astype(np.uint32), w.row
        places, hashes = line_hashes(words, row)
        row = row[places]
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row[keep])), pa.array(hashes[keep].view(np.int64))], ["doc", "line"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct spans of the least length that hold one of a text's frequent lines."""
    for batch in batches:
        for part in chunks([batch]):
            frequent, at = part.column("frequent").flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(part.column("frequent")).to_numpy()))
            out = []
            for i, (_, words, places, hashes) in enumerate(parsed(part.column("text"))):
                n = max(0, len(words) - SPAN + 1)
                p = places[np.isin(hashes.view(np.int64), frequent[at[i] : at[i + 1]])]
                inside = np.zeros(n + 1, np.int64)
                np.add.at(inside, np.minimum(np.maximum(p - (SPAN - HEAD), 0), n), 1)
                np.add.at(inside, np.minimum(p + 1, n), -1)
                out.append(np.unique(rolling(mix(words.astype(np.uint64)), SPAN)[np.cumsum(inside[:n]) > 0]))
            row = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]))
            yield pa.RecordBatch.from_arrays([part.column("doc").take(row), part.column("own").take(row), pa.array(np.concatenate(out).view(np.int64))], ["doc", "own", "span"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks([batch]):
            made = [pack(*x[1:]) for x in parsed(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("rank"), pa.array(made, pa.binary())], ["doc", "rank", "words"])


def cut(text: bytes, ranges: list[tuple[int, int]], start: np.ndarray) -> bytes:
    """``text`` without the words of the ranges and what separates them from the next word."""
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : start[a]])
        at = int(start[b]) if b < len(start) else len(text)
    out.append(text[at:])
    return b"".join(out)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Document:
    """The texts of one id and what of each is to go."""

    def __init__(self) -> None:
        self.texts: dict[bytes, list] = {}

    def add(self, value: str | None, rank: bytes, found: tuple) -> None:
        self.texts.setdefault(text_of(value), [found[0], Text(*found[1:]), [], False, rank])

    def meet(self, partner: bytes) -> None:
        """``partner``: an earlier document as packed words, or the hash of a text of this one that is a copy of an earlier one."""
        if len(partner) == _RANK:
            for item in self.texts.values():
                words = item[1].words
                if item[4] == partner and len(words) >= SPAN:
                    item[2].append((0, len(words)))
                    item[3] = True
            return
        other = None
        for item in self.texts.values():
            _, mine, ranges, whole, _ = item
            if whole:
                continue
            other = other or Text.packed(partner)
            ranges += align(mine, other)
            item[3] = (0, len(mine.words)) in ranges

    def cut(self, value: str | None) -> tuple[str | None, list[tuple[int, int]]]:
        start, _, ranges, _, _ = self.texts.get(text_of(value)) or (None, None, [], False, b"")
        ranges = _union(ranges)
        return (cut(text_of(value), ranges, start).decode("utf-8", "surrogatepass") if ranges else value), ranges


def _delete(names: list[str], text: str):
    """Rows come by document, its texts before its partners' words; all rows of a batch go out together."""

    def out(rows: pa.RecordBatch, changed: dict[int, tuple[str | None, list[tuple[int, int]]]]) -> pa.RecordBatch:
        column = rows.column(text)
        n = rows.num_rows
        mask, size, count = np.zeros(n, bool), np.zeros(n + 1, np.int32), np.zeros(n, np.int64)
        order = sorted(changed)
        for i in order:
            ranges = changed[i][1]
            mask[i], size[i + 1], count[i] = bool(ranges), len(ranges), sum(b - a for a, b in ranges)
        if mask.any():
            column = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i][0] for i in order if mask[i]], column.type))
        flat = [x for i in order for x in changed[i][1]]
        ends = [pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)]
        gone = pa.ListArray.from_arrays(np.cumsum(size, dtype=np.int32), pa.StructArray.from_arrays(ends, ["start", "end"]))
        return pa.RecordBatch.from_arrays([*(column if c == text else rows.column(c) for c in names), gone, pa.array(count)], [*names, "removed", "n_removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, document = None, [], _Document()  # a document that may go on in the next batch

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, document
            for part in held:
                values = part.column(text).to_pylist()
                yield out(part, {i: document.cut(v) for i, v in enumerate(values)} if document.texts else {})
            held, document = [], _Document()

        def read(into: _Document, rows: pa.RecordBatch) -> None:
            for value, rank, found in zip(rows.column(text).to_pylist(), rows.column("__words").to_pylist(), parsed(rows.column(text).cast(pa.string()))):
                into.add(value, rank, found)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("__doc").fill_null(0).to_numpy()
            null = batch.column("__doc").is_null().to_numpy(zero_copy_only=False)
            kinds = batch.column("__kind").to_numpy()
            words, texts = batch.column("__words"), batch.column(text)
            bounds = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])])), len(keys)).tolist()
            done, changed = [], {}
            ends = list(zip(bounds[:-1], bounds[1:]))
            some = np.concatenate([np.arange(a, b)[kinds[a:b] == 0] for a, b in ends if b - a > 1 and kinds[a] == 0 and kinds[b - 1]] or [np.zeros(0, np.int64)])
            ready = dict(zip(some.tolist(), parsed(texts.take(pa.array(some)).cast(pa.string())) if len(some) else ()))
            for at, end in ends:
                key = None if null[at] else int(keys[at])
                split = at + int(np.searchsorted(kinds[at:end], 1))
                if held and key == current:
                    if split > at:  # texts come before partners: more of them means that none has been met
                        held.append(batch.slice(at, split - at))
                    if split < end and not document.texts:
                        for part in held:
                            read(document, part)
                    for i in range(split, end):
                        document.meet(words[i].as_py())
                    continue
                if end == len(keys) and key is not None and split > at:
                    yield from finish()
                    current, held = key, [batch.slice(at, split - at)]
                    if split < end:
                        read(document, held[0])
                    for i in range(split, end):
                        document.meet(words[i].as_py())
                    continue
                if at < split < end:
                    here = _Document()
                    for i in range(at, split):
                        here.add(texts[i].as_py(), words[i].as_py(), ready[i])
                    for i in range(split, end):
                        here.meet(words[i].as_py())
                    for i in range(at, split):
                        changed[len(done)] = here.cut(texts[i].as_py())
                        done.append(i)
                else:
                    done += range(at, split)
            if done:
                yield out(batch.select(names).take(pa.array(done)), changed)
        yield from finish()

    return run


#: A document with more pairs than this is dealt out, with its words, in parts of about this size.
SALT = 256
#: Bits of the map that says which texts may be partners, and words of 64 bits of it in a row: broadcast as 4096 rows of 5 KB at most.
FILTER_BITS, _LINE = 1 << 27, 512
#: Bytes of a text's hash.
_RANK = 16


def _rank(text: str) -> F.Column:
    """128 bits that stand for a text; the same bits for equal texts alone."""
    return F.unhex(F.md5(text))


def _marked(ids: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among the distinct ``ids`` (one column, doc): by a bit map over hashes, whose size is bounded."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = ids.select(place("doc").alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    # some hundred words of 64 bits a row: few rows, and little beside the bits
    listed = F.array_sort(F.collect_list(F.struct(F.expr(f"cast(word % {_LINE} as smallint)").alias("at"), "bits")))
    lines = words.groupBy(F.expr(f"word div {_LINE}").alias("line")).agg(listed.alias("w"))
    lines = lines.select("line", F.col("w.at").alias("places"), F.col("w.bits").alias("bits"))
    placed = rows.withColumn("at", place(column)).withColumn("line", F.expr(f"shiftright(at, 6) div {_LINE}"))
    word = F.expr(f"get(bits, cast(array_position(places, cast(shiftright(at, 6) % {_LINE} as smallint)) as int) - 1)")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return placed.join(F.broadcast(lines), "line").filter(F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns)


def find_pairs(base: DataFrame) -> tuple[DataFrame, str, DataFrame, str]:
    """Of rows (doc, text, rank): pairs (doc, owner), and texts (doc, rank) that are copies of earlier ones; each with its path."""
    spark = base.sparkSession
    lines, lines_at = written(base.select("doc", "text").mapInArrow(tidy(_lines), "doc bigint, line bigint"), "lines")
    counted = lines.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.bit_xor("doc").alias("odd"), F.count("*").alias("n")).filter("first < last")
    # of two or three documents, the one in the middle is what is left of the sum without carries
    rare = counted.filter("n <= 3").withColumn("middle", F.expr("odd ^ first ^ last")).withColumn("middle", F.expr("if(n = 3, middle, first)"))
    rare = rare.select(F.explode(F.expr("array(struct(last AS doc, first AS owner), struct(last AS doc, middle AS owner), struct(middle AS doc, first AS owner))")).alias("pair")).select("pair.*").filter("owner < doc")
    texts = base.select("doc", "rank").distinct()
    shown, shown_at = written(texts.groupBy("doc").agg(F.min("rank").alias("shown"), F.count("*").alias("texts")), "shown")
    firsts = shown.groupBy("shown").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("shown").alias("rank"), "first")
    copies, copies_at = written(texts.join(firsts, "rank").filter("first < doc").select("doc", "rank"), "copies")
    settled = copies.groupBy("doc").agg(F.count("*").alias("texts")).join(shown, ["doc", "texts"]).select("doc")  # nothing of these is left to be aligned
    frequent = lines.join(counted.filter("n > 3").select("line"), "line").groupBy("doc").agg(F.collect_list("line").alias("frequent"))
    gone = copies.groupBy("doc").agg(F.collect_set("rank").alias("gone"))
    about, about_at = written(frequent.join(settled, "doc", "left_anti").join(shown.select("doc", "shown"), "doc").join(gone, "doc", "left"), "frequent")
    ranked = _marked(about.select("doc"), base, "doc").join(about, "doc").filter("gone IS NULL OR NOT array_contains(gone, rank)")
    spans, spans_at = written(ranked.select("doc", "text", F.expr("rank = shown").alias("own"), "frequent").mapInArrow(tidy(_spans), "doc bigint, own boolean, span bigint"), "spans")
    first = spans.groupBy("span").agg(F.min(F.when(F.col("own"), F.col("doc"))).alias("owner"), F.max("doc").alias("last")).filter("owner < last").select("span", "owner")
    exact = spans.join(first, "span").filter("owner < doc").select("doc", "owner")
    pairs, pairs_at = written(rare.join(settled, "doc", "left_anti").union(exact).distinct(), "pairs")
    for path in (lines_at, shown_at, about_at, spans_at):
        drop(spark, path)
    return pairs, pairs_at, copies, copies_at


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and removed (word ranges), n_removed (words), which take the place of columns of those names."""
    limit_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL").withColumn("rank", _rank("text"))
    pairs, _, copies, _ = find_pairs(base)
    salts = pairs.groupBy("owner").agg(F.ceil(F.count("*") / SALT).cast("bigint").alias("salts"))
    hot, _ = written(salts.filter("salts > 1"), "hot")  # so that its size is known where the joins are planned
    words = _marked(salts.select(F.col("owner").alias("doc")), base, "doc").mapInArrow(tidy(_words), "doc bigint, rank binary, words binary")
    words = words.groupBy("doc").agg(F.min_by("words", "rank").alias("words")).withColumnRenamed("doc", "owner")
    words = words.join(hot, "owner", "left").select("owner", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"))
    dealt = pairs.join(hot, "owner", "left").select("owner", "doc", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).alias("salt"))
    partners = dealt.join(words, ["owner", "salt"]).select("doc", "words").union(copies.select("doc", F.col("rank").alias("words")))
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("removed", "n_removed")]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names)], F.col(f"`{doc_id}`").cast("bigint").alias("__doc"), F.lit(0).alias("__kind"), _rank(f"`{text}`").alias("__words"))
    met = partners.select(*[F.lit(None).cast(f.dataType).alias(n) for f, n in zip(kept, names)], F.col("doc").alias("__doc"), F.lit(1).alias("__kind"), F.col("words").alias("__words"))
    added = StructType.fromDDL("removed array<struct<start:bigint,end:bigint>>, n_removed bigint")
    schema = StructType([*(StructField(n, f.dataType, True) for f, n in zip(kept, names)), *added.fields])
    mine = next(n for f, n in zip(kept, names) if f.name == text)
    # rows without an id meet nobody: they go by their text
    rows = rows.union(met).repartition(F.coalesce("__doc", F.xxhash64("__words"))).sortWithinPartitions("__doc", "__kind")
    out = rows.mapInArrow(tidy(_delete(names, mine)), schema)
    return out.select(*[F.col(n).alias(f.name) for f, n in zip(kept, names)], "removed", "n_removed")
