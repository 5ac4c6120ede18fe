"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: the majority of each of the 64 bits over the XXH64 of all word
shingles. The distinct fingerprints are dealt out to buckets of about ``BUCKET``
codes, and each bucket is a hierarchical index: its codes are sorted by Gray
rank, groups of neighbours become leaves, groups of leaves upper nodes, and each
node factors out the bits that all of its codes share (a mask and a pattern).
Pairs of nodes are walked from the top: bits that both share and in which they
differ accumulate, groups with more than r of them are pruned whole; pairs whose
codes must all be within r are linked whole; pairs that are one component
already are skipped. A bucket returns a spanning forest instead of pairs, so a
dense group of g codes costs g - 1 links. The links' components come from
alternating stars in DataFrame joins.

Buckets: two fingerprints with at most r differing bits agree in c of r + c
bands at least. A bucket is a choice of c bands and the top bits of each, as many
as bring the buckets down to their size, so no link is lost; the number of
codes, which is counted first, decides the bits and whether c is 1, 2 or 3. Few
codes are one bucket.

Skew: equal fingerprints are one node, so groups of copies cost one row. A
bucket of more than ``split`` codes is salted, and each pair of salts is a block
of its own.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; texts of any length are hashed whole, some shingles at a time; a null
id is a document, but never names a component unless all ids of it are null;
repeated rows give equal results each; further columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.tables import components, drop, written
from sketchloom.llm.textkit import Carried, Words, chunks, limit_batches, mix, pick, raw, rolling, text_of, tidy, words_of

SHINGLE, SEED, RADIUS = 3, 42, 3
LEAF, FAN = 16, 8
#: Codes of a bucket on average, where bands have bits enough for so many buckets.
BUCKET = 512
#: Codes of a bucket that one task handles; larger buckets are dealt out in blocks.
SPLIT = 1 << 17
#: With more codes a bucket than this on average, one more band has to agree.
FULL = 1 << 14
_STEP = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length + 1) - length - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = first[:n].tolist(), (first + length)[len(words) - n :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in the Gray sequence."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its group) after the links i-j."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


class Index:
    """The hierarchy over the codes of one bucket, which must be in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.size = [LEAF]
        bounds = np.arange(0, len(codes), LEAF)
        self.both = [np.bitwise_and.reduceat(codes, bounds)]
        self.any = [np.bitwise_or.reduceat(codes, bounds)]
        while len(self.both[-1]) > FAN:
            bounds = np.arange(0, len(self.both[-1]), FAN)
            self.size.append(self.size[-1] * FAN)
            self.both.append(np.bitwise_and.reduceat(self.both[-1], bounds))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], bounds))

    def groups(self, radius: int) -> np.ndarray:
        """A label for each code: the smallest index that is linked to it, over any number of links."""
        codes, n = self.codes, len(self.codes)
        labels = np.arange(n)
        for d in range(1, LEAF):  # Gray neighbours first: they join most of a dense group
            near = np.flatnonzero(np.bitwise_count(codes[d:] ^ codes[:-d]) <= radius)
            labels = merge(labels, near, near + d)
        top = len(self.both) - 1
        a, b = np.triu_indices(len(self.both[top]))
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 4096:
                stack.append((level, a[4096:], b[4096:]))
                a, b = a[:4096], b[:4096]
            both, any_ = self.both[level], self.any[level]
            mask = ~(both ^ any_)
            differ = np.bitwise_count((both[a] ^ both[b]) & mask[a] & mask[b]).astype(np.int64)
            free = 64 - np.bitwise_count(mask[a] & mask[b]).astype(np.int64)
            size = self.size[level]
            bounds = np.arange(0, n, size)
            low, high = np.minimum.reduceat(labels, bounds), np.maximum.reduceat(labels, bounds)
            open_ = (differ <= radius) & ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            whole = open_ & (differ + free <= radius)
            for x, y in zip(a[whole].tolist(), b[whole].tolist()):
                members = np.concatenate([np.arange(x * size, min(n, (x + 1) * size)), np.arange(y * size, min(n, (y + 1) * size))])
                labels = merge(labels, members, np.full(len(members), members[0]))
            a, b = a[open_ & ~whole], b[open_ & ~whole]
            if not len(a):
                continue
            if level:
                fan = np.arange(FAN)
                x = (a[:, None, None] * FAN + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
                y = (b[:, None, None] * FAN + 0 * fan[None, :, None] + fan[None, None, :]).ravel()
                count = len(self.both[level - 1])
                keep = (x <= y) & (x < count) & (y < count)
                stack.append((level - 1, x[keep], y[keep]))
                continue
            leaf = np.arange(LEAF)
            x, y = np.minimum(a[:, None] * LEAF + leaf, n - 1), np.minimum(b[:, None] * LEAF + leaf, n - 1)
            near = np.bitwise_count(codes[x][:, :, None] ^ codes[y][:, None, :]) <= radius
            p, i, j = np.nonzero(near)
            labels = merge(labels, x[p, i], y[p, j])
        return labels


def bucket_links(bucket: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (code, code) of the links inside each bucket; rows in bucket order."""
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    labels = np.arange(len(codes))
    for at, n in zip(first.tolist(), size.tolist()):
        labels[at : at + n] = at + Index(codes[at : at + n]).groups(radius)
    linked = labels != np.arange(len(labels))
    return codes[linked], codes[labels[linked]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(bucket, codes):
            a, b = bucket_links(bucket, codes, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            bucket, codes = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(bucket):
                continue
            at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if at:
                held.append((bucket[:at], codes[:at]))
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            elif held and held[0][0][-1] != bucket[0]:
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            held.append((bucket[at:], codes[at:]))
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    return run


def _prints(shingle: int, seed: int, key: str = "doc_id"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = np.array([fingerprint(text_of(t), shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(got.view(np.int64))], [key, "fp"])

    return run


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint's bits as a signed long)."""
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(tidy(_prints(shingle, seed)), "doc_id bigint, fp bigint")


def bands(count: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For ``count`` codes: choices of bit ranges (from, to), in one of which any two codes within the radius agree."""
    if count <= BUCKET:
        return [[]]
    for agree in (1, 2, 3):
        edge = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
        width = min(b - a for a, b in zip(edge, edge[1:]))
        if count <= FULL << agree * width or agree == 3:
            bits = min(width, max(1, -(-(-(-count // BUCKET) - 1).bit_length() // agree)))
            return [[(hi - bits, hi) for hi in chosen] for chosen in combinations(edge[1:], agree)]
    raise AssertionError


def links(codes: DataFrame, count: int, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect the ``count`` distinct codes ``fp`` as all pairs within ``radius`` would."""
    keys = []
    for i, ranges in enumerate(choices := bands(count, radius)):
        bits = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in ranges]
        keys.append(F.xxhash64(F.lit(i), *bits))
    spread = codes.select("fp", F.explode(F.array(*keys)).alias("band")) if len(choices) > 1 else codes.select("fp", keys[0].alias("band"))
    hot = spread.groupBy("band").count().filter(F.col("count") > split).select("band", F.ceil(F.col("count") / split).cast("bigint").alias("salts"))
    dealt = spread.join(hot, "band", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))))
    others = F.expr("CASE WHEN salts IS NULL THEN array(0L) ELSE transform(sequence(0L, salts - 1), q -> least(salt, q) * salts + greatest(salt, q)) END")
    dealt = dealt.select("fp", "band", F.explode(others).alias("block")).select("fp", F.xxhash64("band", "block").alias("bucket"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_links(radius)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    prints, _ = written(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed), "prints")
    nodes, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    stars, _ = components(links(nodes.select("fp"), nodes.count(), radius, split))
    grouped = nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicate texts: at five words and a similarity of 0.8, fingerprints of 64 bits differ in about ten, which no
# division into bands can search without pairing nearly everything. So the links above are joined by candidates from
# minima of shingle hashes, and every candidate of either kind is compared in full, unless both texts are in one
# component already.

SIMILARITY, TEXT_SHINGLE = 0.8, 5
#: Of 16 bands of 5 minima one is equal with a probability of 0.998 at a similarity of 0.8.
MINIMA_BANDS, MINIMA_ROWS = 16, 5
#: Members of a bucket, and shingles of theirs, that one salt holds; a block has two salts.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = _PLAIN[32] = 0


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their rows, in row order; fewer words, or none, are one shingle."""
    w: Words = words_of(data, offsets, _PLAIN)
    rows = len(offsets) - 1
    count = np.bincount(w.row, minlength=rows)
    h = rolling(w.hash, k)
    keep = w.row[: len(h)] == w.row[k - 1 :]
    h, row = h[keep], w.row[: len(h)][keep]
    short = np.flatnonzero(count < k)
    if len(short):
        first = np.cumsum(count) - count
        whole = np.zeros(len(short), np.uint64)
        for i, (at, n) in enumerate(zip(first[short].tolist(), count[short].tolist())):
            whole[i] = int.from_bytes(xxhash.xxh64_digest(w.hash[at : at + n].tobytes(), SEED), "big")
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def minima(h: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation minima (rows x bins); an empty bin takes the next filled one's, marked by the distance."""
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    order = np.lexsort((h, row))
    key = (row * bins + at.astype(np.int64))[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.full(rows * bins, _EMPTY)
    out[key[first]] = h[order][first]
    out = out.reshape(rows, bins)
    for step in range(1, bins):
        gaps = out == _EMPTY
        if not gaps.any():
            break
        if step == 1:
            filled = out.copy()
        moved = np.roll(filled, -step, axis=1)
        out = np.where(gaps & (moved != _EMPTY), mix(moved + np.uint64(step)), out)
    return out


def _band_keys(shingle: int, bands: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, row = shingles(*raw(batch.column("text")), shingle)
            low = minima(h, row, batch.num_rows, bands * per).reshape(batch.num_rows, bands, per)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for i in range(per):
                keys = mix(keys + low[:, :, i] + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
            flat = pa.array(keys.ravel().view(np.int64))
            sets = _sets(h, row, batch.num_rows)
            same = pa.array([xxhash.xxh128_digest(x.tobytes(), SEED) for x in sets], pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("node"), same, pa.array([len(x) for x in sets], pa.int64()), lists], ["node", "same", "size", "keys"])

    return run


def _sets(h: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """The distinct shingles of each row, in order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    ends = np.searchsorted(row, np.arange(rows + 1))
    return [h[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _similar(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "text_a"):
                sets = [_sets(*shingles(*raw(part.column(side)), shingle), part.num_rows) for side in ("text_a", "text_b")]
                keep = []
                for x, y in zip(*sets):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common >= least * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def block_pairs(sets: list[np.ndarray], labels: np.ndarray, salts: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that join what ``labels`` keeps apart, as all pairs would; between the salts if there are two."""
    size = np.array([len(x) for x in sets], np.int64)
    first = np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(len(sets)), size)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    mine, labels, cross, out = np.zeros(len(values), bool), labels.copy(), salts.min() != salts.max(), []
    for i in range(len(sets) - 1):
        open_ = labels[i + 1 :] != labels[i]
        if cross:
            open_ &= salts[i + 1 :] != salts[i]
        if not open_.any():
            continue
        mine[at[first[i] : first[i + 1]]] = True
        rest = slice(first[i + 1], None)
        common = np.bincount(owner[rest][mine[at[rest]]] - i - 1, minlength=len(open_))
        mine[at[first[i] : first[i + 1]]] = False
        for j in (i + 1 + np.flatnonzero(open_ & (common >= least * (size[i] + size[i + 1 :] - common)))).tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def _compared(shingle: int, least: float):
    """Rows come by block; a block's shingle sets are held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, sets = None, [], []

        def out() -> pa.RecordBatch:
            node, label, salt = zip(*held)
            numbers = {x: i for i, x in enumerate(dict.fromkeys(label))}
            found = block_pairs(sets, np.array([numbers[x] for x in label]), np.array(salt), least)
            return pa.RecordBatch.from_arrays([pa.array([node[x[side]] for x in found], pa.binary()) for side in (0, 1)], ["a", "b"])

        for batch in chunks(batches):
            some = _sets(*shingles(*raw(batch.column("text")), shingle), batch.num_rows)
            block, *rest = (batch.column(c).to_pylist() for c in ("block", "node", "label", "salt"))
            for key, item, shingles_ in zip(block, zip(*rest), some):
                if key != current and held:
                    yield out()
                    held, sets = [], []
                current = key
                held.append(item)
                sets.append(shingles_)
        if held:
            yield out()

    return run


#: Bins that tell rare shingles from frequent ones; any order of shingles gives right results.
RARITY_BINS = 1 << 18


def _bins(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(46)).astype(np.int64)


def _tallied(shingle: int):
    """How many of the texts' shingles are in each bin, a row for each bin that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY_BINS, np.int64)
        for batch in chunks(batches):
            for one in _sets(*shingles(*raw(batch.column("text")), shingle), batch.num_rows):
                n += np.bincount(_bins(one), minlength=RARITY_BINS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bin", "n"])

    return run


def _rarest(shingle: int, least: float, frequency: np.ndarray):
    """(node, token): of each text the rarest shingles, so many that a similar text has one of its own rarest among them; without those that no other text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, counts = [], []
            for one in _sets(*shingles(*raw(batch.column("text")), shingle), batch.num_rows):
                often = frequency[_bins(one)]
                order = np.lexsort((one, often))[: len(one) - math.ceil(least * len(one) - 1e-9) + 1]
                order = order[often[order] > 1]
                tokens.append(one[order])
                counts.append(len(order))
            rows = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), pa.array(np.concatenate(tokens).view(np.int64))], ["node", "token"])

    return run


def _kin(texts: DataFrame, shingle: int, least: float) -> tuple[DataFrame, str]:
    """(node, bucket) of texts that are connected by rare shingles with another one; bucket is the smallest of those."""
    texts = texts.select("node", "text")
    tally = texts.mapInArrow(tidy(_tallied(shingle)), "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    frequency = np.zeros(RARITY_BINS, np.int64)
    for r in tally.collect():  # a row for each bin
        frequency[r["bin"]] = r["n"]
    rare, rare_at = written(texts.mapInArrow(tidy(_rarest(shingle, least, frequency)), "node binary, token bigint"), "rare")
    firsts = rare.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("token", "first")
    joined, path = components(rare.join(firsts, "token").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    drop(texts.sparkSession, rare_at)
    return joined.select(F.col("a").alias("node"), F.col("b").alias("bucket")).union(joined.select(F.col("b").alias("node"), F.col("b").alias("bucket")).distinct()), path


def _labelled(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _node(text: str) -> F.Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def near_texts(docs: DataFrame, *, text: str = "text", shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Groups of near-duplicate texts: (node, root), node the md5 of a text, for each text but those that stand alone.

    Copies are put together first, before any exchange; then texts of equal shingle sets are one. Each bucket's members are
    first compared with its smallest and largest. What that leaves in more than one component of a bucket goes on: two texts
    that are similar enough share one of the rarest shingles of each (prefix filter), so only texts that are connected by
    these are compared with each other, in blocks of pairs of salts. Unlike texts in one bucket so cost as much as they are
    long, however many; texts that share most of their shingles without being similar enough are compared all with all.
    """
    limit_batches(docs.sparkSession)
    texts, texts_at = written(docs.select(_node(text).alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).dropDuplicates(["node"]), "texts")
    keys, keys_at = written(texts.mapInArrow(tidy(_band_keys(shingle, MINIMA_BANDS, MINIMA_ROWS)), "node binary, same binary, size bigint, keys array<bigint>"), "minima")
    prints = texts.mapInArrow(tidy(_prints(shingle, SEED, "node")), "node binary, fp bigint")
    firsts = keys.groupBy("same").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal, equal_at = written(keys.select("node", "same").join(firsts, "same").filter("node <> first").select("node", "first"), "equal")
    by_minima = keys.join(equal, "node", "left_anti").select("node", F.explode("keys").alias("bucket"))
    # Two codes within the radius are in one component of a band bucket, whose root so names a bucket that holds both.
    codes, codes_at = written(prints.join(equal, "node", "left").select(F.coalesce("first", "node").alias("node"), "fp").distinct(), "prints")
    heads, heads_at = written(codes.groupBy("fp").agg(F.count("*").alias("n")), "codes")
    forest, forest_at = written(links(heads.select("fp"), heads.count(), radius), "links")
    grouped = forest.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(forest.select(F.col("b").alias("fp"), F.col("b").alias("root"))).union(heads.filter("n > 1").select("fp", F.col("fp").alias("root"))).distinct()
    by_code = codes.join(grouped, "fp").select("node", F.xxhash64(F.lit("code"), "root").alias("bucket"))
    buckets, buckets_at = written(by_minima.union(by_code), "buckets")
    ends, ends_at = written(buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high"), "ends")
    near = buckets.join(ends, "bucket").select("node", F.explode(F.array("low", "high")).alias("other"))
    pairs = near.filter("node <> other").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    pairs, pairs_at = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found, found_at = written(texts.join(wanted, "node", "left_semi"), "texts")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    stars, stars_at = components(both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_similar(shingle, similarity)), "a binary, b binary").union(equal))
    # What only an end of a bucket was compared with so far, and isn't linked: all of it that shares rare shingles is compared.
    inner = _labelled(buckets.join(ends.filter("n > 3"), "bucket").filter("node <> low AND node <> high").select("bucket", "node"), stars)
    apart = inner.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    left, left_at = written(inner.join(apart, "bucket").select("node", "label").distinct().join(found, "node"), "left")
    kin, kin_at = _kin(left, shingle, similarity)
    members = left.select("node", "label").join(kin, "node").join(keys.select("node", "size"), "node")
    open_ = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size")).filter("low < high")
    open_ = open_.select("bucket", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("bigint").alias("salts"))
    dealt = members.select("node", "label", "bucket").join(open_, "bucket").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("salts")))
    blocks = F.expr("transform(sequence(0L, salts - 1), q -> least(salt, q) * salts + greatest(salt, q))")
    members, members_at = written(dealt.select("node", "label", "salt", "bucket", F.explode(blocks).alias("block")).select("node", "label", "salt", F.xxhash64("bucket", "block").alias("block")), "members")
    rest = members.join(left.select("node", "text"), "node").repartition("block").sortWithinPartitions("block")
    last, _ = components(stars.select("a", "b").union(rest.mapInArrow(tidy(_compared(shingle, similarity)), "a binary, b binary")))
    for path in (texts_at, keys_at, equal_at, codes_at, heads_at, forest_at, buckets_at, ends_at, pairs_at, found_at, stars_at, left_at, kin_at, members_at):
        drop(docs.sparkSession, path)
    return last.select(F.col("a").alias("node"), F.col("b").alias("root")).union(last.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id (nulls first, ties by md5 of the text) stays.

    A text of any length is shingled whole; null and empty texts are copies of each other; of repeated rows one stays;
    all columns are kept, whatever their names; an empty table gives no rows.
    """
    groups = near_texts(docs, text=text, shingle=shingle, similarity=similarity, radius=radius)
    carried = Carried(docs)
    rows = docs.select(*carried.columns, _node(text).alias("node"), F.col(f"`{doc_id}`").alias("id"))
    firsts = rows.groupBy("node").agg(F.min(F.struct("id")).alias("first")).join(groups, "node", "left")
    heads = firsts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first.id", "node")).alias("head"))
    heads = heads.select(F.col("head.id").alias("head"), F.col("head.node").alias("of"))
    kept = rows.join(heads, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("head")), "left_semi")
    return carried.back(kept.dropDuplicates(["node"]))
