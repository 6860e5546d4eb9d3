"""Near duplicates: 128-bit SimHash fingerprints, searched exactly with indexes of their blocks and vantage-point trees.

A fingerprint is the majority, bit by bit, over a text's different words, each weighted by the root of its count.  Two
documents are near duplicates if their fingerprints differ in at most ``RADIUS`` bits; how long they are, and in
which order the words come, doesn't matter.  The triangle inequality holds for Hamming distance, so vantage points bound it:

* equal fingerprints are collapsed first; only distinct ones are searched;
* shards are ranges of the sides and distances of fixed vantage points; shards whose distances to some vantage point are further apart
  than the radius aren't compared, each other pair of shards is a task;
* in a task, the shard is indexed by each of 6 to 12 blocks of its bits.  The radius is dealt out to the blocks so that near fingerprints
  are within its share in at least one (pigeonhole); a query looks up every value within the share of its own, and is compared with what
  has it.  A pair counts in the first block that brings it together;
* where so many share a block's values that this compares more, a vantage-point tree over the shard instead: a query goes down the
  sides that the triangle inequality leaves it, and is compared bit by bit with the leaves it comes to.

Where fingerprints are spread evenly vantage points rule hardly anything out, since 18 bits are too many, so every two shards meet; the
index then compares a few of thousands of pairs.  From ``BLOCKS_FROM`` fingerprints on, the table itself is cut by pigeonhole: of the four blocks of 32
bits, one differs in at most four bits, so two near fingerprints meet at a value that is two bits at most from that block of either.
What meets there is a shard, and compared as above.  All ways are exact and find the same pairs.

A task reports a spanning forest of the pairs it finds, which has the same connected components as
all its pairs; ``pairs`` reports them all.  The components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Words, field, maybe_broadcast, mix, over_texts, released, ship, small, stored, texts_of, written

#: Bits, of 128, in which fingerprints of near duplicates may differ; under 20, so that the pigeonhole holds.
RADIUS = 18
#: Fingerprints of a shard, about; large tables are cut into SHARDS of them, or into more where one would have over LARGE times as many.
SHARD = 32_768
SHARDS = 8
LARGE = 16
#: Distinct fingerprints from which on the pigeonhole between tasks is worth 2,116 rows a fingerprint (shuffled, over 80 KB).
BLOCKS_FROM = 150_000_000
#: Rows of a task of the pigeonhole, about.
BUCKET = 1 << 20
#: Fingerprints in a leaf of a task's tree.
LEAF = 256
#: Pairs of two shards from which on an index is considered, and the numbers of blocks that it may have.
INDEX_FROM = 1 << 24
_CUTS = range(6, 13)
#: Seconds, in units of comparing one pair in a leaf, of looking up one value and of comparing one pair that it brings together.
_LOOKUP, _MET = 6, 12
#: Queries that are looked up at once, pairs that are compared at once: bound a worker's memory, not the result.
LOOKED_UP = 1 << 14
MET_AT_ONCE = 1 << 18
#: Queries compared with a leaf at once, and pairs handed on at once: bound a worker's memory, not the result.
BLOCK = 256
PAIRS_AT_ONCE = 1 << 20
_SPREAD = np.zeros(256, np.uint64)
for _b in range(256):
    _SPREAD[_b] = sum(((_b >> i) & 1) << (8 * i) for i in range(8))
#: Vantage points: no word, every word, and random ones.
_VANTAGE = np.concatenate([np.array([[0, 0], [2**64 - 1, 2**64 - 1]], np.uint64), np.random.default_rng(99).integers(0, 1 << 64, (6, 2), dtype=np.uint64)])
#: What two fingerprints' blocks are changed by to meet: at most two of 32 bits.
_FLIPS = [0, *(1 << i for i in range(32)), *(1 << i | 1 << j for i in range(32) for j in range(i))]


def fingerprints(words: Words) -> np.ndarray:
    """Two 64-bit halves per row: of each bit, whether the different words that have it weigh more than half; a word weighs twice the root of its count, rounded."""
    rows = len(words.first) - 1
    order = np.lexsort((words.hash, words.doc))
    h, doc = words.hash[order], words.doc[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    weight = np.rint(2 * np.sqrt(np.diff(np.append(begin, len(h))))).astype(np.int64)
    pair, doc = np.repeat(mix(h[begin]), weight), np.repeat(doc[begin], weight)
    del h, order
    first = np.searchsorted(doc, np.arange(rows + 1))
    out = np.zeros((rows, 2), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    # eight counters of a byte each in a 64-bit sum, over runs of at most 255; then the runs' sums
    cuts = np.unique(np.concatenate([first[full], np.concatenate([np.arange(first[r], first[r + 1], 255) for r in full])]))
    of = np.searchsorted(first[full], cuts, side="right") - 1
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    half = (np.diff(first)[full] / 2)[:, None]
    for k in range(2):
        v = pair if k == 0 else mix(pair ^ np.uint64(0xD6E8FEB86659FD93))
        octets = v.view(np.uint8).reshape(-1, 8)
        bits = np.zeros(len(full), np.uint64)
        for b in range(8):
            sums = np.add.reduceat(_SPREAD[octets[:, b]], cuts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(sums, starts, axis=0, dtype=np.int64) > half
            bits |= (np.packbits(ones, axis=1, bitorder="little")[:, 0].astype(np.uint64)) << np.uint64(8 * b)
        out[full, k] = bits
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, __wl_key (hash of the text), hi, lo, n (words) of each row whose text isn't empty; one pass, no shuffle."""
    ship(docs.sparkSession)
    keyed = texts_of(docs, id_col, text_col).withColumn("__wl_key", F.xxhash64(text_col))
    schema = T.StructType([field(docs, id_col), *(T.StructField(c, T.LongType()) for c in ("__wl_key", "hi", "lo", "n"))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        fp, n = fingerprints(words), words.count()
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        bare = (n == 0) & (size > 0)  # no words: the hash of the text, so that exact copies are equal
        key = batch.column(2).to_numpy(zero_copy_only=False)[bare].view(np.uint64)
        fp[bare] = np.stack([mix(key), mix(key ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
        fp = fp.view(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(n.astype(np.int64))], names=schema.names)
        return out.filter(pa.array(size > 0))

    return keyed.mapInArrow(over_texts(work), schema)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of ``a`` and all of ``b``."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    d += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    return d


def vp_tree(fp: np.ndarray, leaf: int = LEAF) -> tuple:
    """Nested sides of a vantage-point tree: (rows, None) of a leaf, or (vantage row, sides: least, largest distance, tree)."""
    root: list = []
    todo: list[tuple[np.ndarray, list, tuple]] = [(np.arange(len(fp)), root, ())]
    while todo:
        rows, into, bounds = todo.pop()
        d = hamming(fp[rows], fp[rows[:1]])[:, 0].astype(int) if len(rows) > leaf else None
        if d is None or d.max() == d.min():
            into.append((*bounds, (rows, None)))
            continue
        mu = int(np.median(d))
        inside = d <= mu if mu < d.max() else d < mu
        sides: list = []
        into.append((*bounds, (int(rows[0]), sides)))
        todo += [(rows[side], sides, (int(d[side].min()), int(d[side].max()))) for side in (inside, ~inside)]
    return root[0][-1]


def shard_pairs(query: np.ndarray, data: np.ndarray, own: bool, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, data row, distance) of all near pairs between two sets of fingerprints; if ``own``, of one set, each once."""
    halves = lambda fp: [np.ascontiguousarray(fp[:, i]) for i in range(2)]
    (dh, dl), (qh, ql) = halves(data), halves(query)
    xor, bits_, hit = np.empty((leaf, BLOCK), np.uint64), np.empty((leaf, BLOCK), np.uint8), np.empty((leaf, BLOCK), bool)
    eight = np.arange(8)

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Flat places of the pairs of halves that differ in at most ``radius`` bits."""
        if len(b) < BLOCK:
            return np.flatnonzero(np.bitwise_count(a[:, None] ^ b) <= radius)
        n = len(a)
        np.bitwise_xor(a[:, None], b, out=xor[:n])
        np.bitwise_count(xor[:n], out=bits_[:n])
        np.less_equal(bits_[:n], radius, out=hit[:n])
        flat = hit[:n].reshape(-1)
        at = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + eight).ravel()  # eight at a time: hits are rare
        return at[flat[at]]

    done = np.zeros(len(query), bool)  # if own: leaves compared with all that is near them
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    todo = [(vp_tree(data, leaf), np.arange(len(query)))]
    while todo:
        (node, sides), q = todo.pop()
        if sides is not None:
            d = hamming(query[q], data[node : node + 1])[:, 0].astype(int)
            todo += [(tree, q[(d >= lo - radius) & (d <= hi + radius)]) for lo, hi, tree in sides]
            continue
        for rows in (node[i : i + leaf] for i in range(0, len(node), leaf)):
            if own:
                q = q[~done[q]]
                done[rows] = True
            high, asked = dh[rows], qh[q]
            for at in range(0, len(q), BLOCK):
                part = q[at : at + BLOCK]
                near = within(high, asked[at : at + BLOCK])  # one half alone: of pairs that are apart, hardly any go on
                if not len(near):
                    continue
                i, j = np.divmod(near, len(part))
                a, b = part[j], rows[i]
                dist = (np.bitwise_count(dh[b] ^ qh[a]) + np.bitwise_count(dl[b] ^ ql[a])).astype(np.int64)
                fine = dist <= radius
                a, b, dist = a[fine], b[fine], dist[fine]
                if own:  # of two in this leaf, once
                    once = ~done[a] | (b < a)
                    a, b, dist = a[once], b[once], dist[once]
                held.append((a, b, dist))
                count += len(a)
                if count >= PAIRS_AT_ONCE:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, count = [], 0
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held))


def index_blocks(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, share) of ``n`` blocks of 128 bits. Two fingerprints within the radius differ in at most ``share`` bits of some block; -1: of others than this."""
    size, share = [128 // n + (i < 128 % n) for i in range(n)], [(radius + 1) // n + (i < (radius + 1) % n) - 1 for i in range(n)]
    return [(sum(size[:i]), size[i], share[i]) for i in range(n)]


@lru_cache(None)
def _changes(width: int, share: int) -> dict[int, list[int]]:
    """By their highest bit (-1: none), what at most ``share`` bits of ``width`` are changed by."""
    out: dict[int, list[int]] = {}
    for k in range(share + 1):
        for bits in combinations(range(width), k):
            out.setdefault(max(bits, default=-1), []).append(sum(1 << b for b in bits))
    return out


def _block(fp: np.ndarray, at: int, width: int) -> np.ndarray:
    """Bits ``at`` to ``at`` + ``width`` of each fingerprint, counted from the least of the second half."""
    hi, lo = fp[:, 0], fp[:, 1]
    v = hi >> np.uint64(at - 64) if at >= 64 else lo >> np.uint64(at)
    if at < 64 < at + width:
        v = v | hi << np.uint64(64 - at)
    return (v & np.uint64((1 << width) - 1)).astype(np.int64)


def cheapest_index(query: np.ndarray, data: np.ndarray, own: bool, radius: int) -> int:
    """The number of blocks with which the index costs least, by some of the queries; 0 if comparing all pairs costs less."""
    some = query[:: max(1, len(query) // 256)]
    best, least = 0, float(len(data)) * (0.5 if own else 1)
    for n in _CUTS:
        cost, blocks = 0.0, index_blocks(n, radius)
        if blocks[0][2] > 3:  # too many values to look up
            continue
        for at, width, share in blocks:
            if share < 0:
                continue
            size = np.bincount(_block(data, at, width), minlength=1 << width)
            changes = np.array([f for fs in _changes(width, share).values() for f in fs])
            met = sum(int(size.take(v ^ changes).sum()) for v in _block(some, at, width))
            cost += (len(changes) * _LOOKUP + met / len(some) * _MET) * (0.5 if own else 1)
        if cost < least:
            best, least = n, cost
    return best


def indexed_pairs(query: np.ndarray, data: np.ndarray, own: bool, radius: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``shard_pairs`` gives, by an index of ``n`` blocks."""
    blocks = index_blocks(n, radius)
    every = np.arange(max(MET_AT_ONCE, len(data)) + 1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    for k, (at, width, share) in enumerate(blocks):
        if share < 0:
            continue
        value = _block(data, at, width)
        order = np.argsort(value, kind="stable")
        size = np.bincount(value, minlength=1 << width).astype(np.int32)
        first = (np.cumsum(size) - size).astype(np.int32)
        asked, asker = (value, order) if own else ((v := _block(query, at, width)), np.argsort(v, kind="stable"))
        asked = asked[asker]
        far = 0 if at + width // 2 < 64 else 1  # the half that the block isn't in tells pairs apart best
        there, here = data[order, far], query[asker, far]
        for top, changes in _changes(width, share).items():
            some = np.flatnonzero(asked >> top & 1 == 0) if own and top >= 0 else np.arange(len(asked))  # if own: the lesser value looks up the greater
            for part in (some[i : i + LOOKED_UP] for i in range(0, len(some), LOOKED_UP)):
                v, half = asked[part], here[part]
                for change in changes:
                    u = v ^ change
                    many = size.take(u)
                    if own and not change:  # each with those that come after it
                        begin = part + 1
                        many = first.take(u) + many - begin
                        full = np.flatnonzero(many)
                        begin = begin.take(full)
                    else:
                        full = np.flatnonzero(many)
                        begin = first.take(u.take(full))
                    many = many.take(full)
                    total = np.cumsum(many, dtype=np.int64)
                    i = 0
                    while i < len(full):
                        before = int(total[i - 1]) if i else 0
                        j = max(int(np.searchsorted(total, before + MET_AT_ONCE, side="right")), i + 1)
                        times, upto = many[i:j], total[i:j] - before
                        row = np.repeat(begin[i:j] - upto + times, times)
                        row += every[: upto[-1]]
                        x = np.repeat(half.take(full[i:j]), times)
                        x ^= there.take(row)
                        near = np.flatnonzero(np.bitwise_count(x) <= radius)
                        if len(near):
                            a, b = asker[part[full[i + np.searchsorted(upto, near, side="right")]]], order[row[near]]
                            d = query[a] ^ data[b]
                            dist = np.bitwise_count(d).sum(axis=1, dtype=np.int64)
                            fine = dist <= radius
                            for at_, width_, share_ in blocks[:k]:
                                fine &= np.bitwise_count(_block(d, at_, width_)) > share_ if share_ >= 0 else True
                            held.append((a[fine], b[fine], dist[fine]))
                            count += len(held[-1][0])
                            if count >= PAIRS_AT_ONCE:
                                yield tuple(np.concatenate(x) for x in zip(*held))
                                held, count = [], 0
                        i = j
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held))


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up[:] = nxt

    def add(self, a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> None:
        r = self.roots().copy()
        new = r[a] != r[b]  # most pairs of a large group are inside one tree already
        for i, j, d in zip(a[new].tolist(), b[new].tolist(), dist[new].tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((i, j, d))


def _distance(v: np.ndarray) -> Column:
    return F.bit_count(F.col("hi").bitwiseXOR(F.lit(int(v[:1].view(np.int64)[0])))) + F.bit_count(F.col("lo").bitwiseXOR(F.lit(int(v[1:].view(np.int64)[0]))))


def _in_shards(fps: DataFrame, n: int, radius: int, shard: int) -> DataFrame:
    """hi, lo, at (own shard), s, t: each fingerprint once for every pair of shards (s <= t) that it is compared in."""
    shards = max(1, -(-n // shard))
    far = [_distance(v) for v in _VANTAGE]
    code = sum((F.when(d > 64, 1 << (len(far) - 1 - j)).otherwise(0) for j, d in enumerate(far)), F.lit(0))
    placed = written(fps.withColumn("code", code).repartitionByRange(shards, "code", "hi", "lo").withColumn("at", F.spark_partition_id()).drop("code"))
    edges = placed.groupBy("at").agg(*(f(d).alias(f"{f.__name__}{j}") for j, d in enumerate(far) for f in (F.min, F.max))).orderBy("at").collect()  # a row per shard: BLOCKS_FROM / (LARGE * SHARD) at most
    at = np.array([r["at"] for r in edges])
    low, high = (np.array([[r[f"{f}{j}"] for j in range(len(far))] for r in edges]).reshape(-1, len(far)) for f in ("min", "max"))
    meets = [(int(at[i]), int(at[j])) for i in range(len(at)) for j in i + np.flatnonzero(((low[i:] - high[i] <= radius) & (low[i] - high[i:] <= radius)).all(axis=1))]
    # numbers that a shuffle by hash sends to different tasks, so that each gets one pair of shards
    tasks = max(1, len(meets))
    own = [r["bucket"] for r in fps.sparkSession.range(32 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks))).agg(F.min("id").alias("bucket")).collect()]
    ends = [(at, s, t, own[i % len(own)]) for i, (s, t) in enumerate(meets) for at in {s, t}]
    return placed.join(F.broadcast(fps.sparkSession.createDataFrame(ends, "at int, s int, t int, bucket long")), "at").repartition(tasks, "bucket")


def _in_blocks(fps: DataFrame, n: int, shard: int) -> DataFrame:
    """The same by pigeonhole: of every fingerprint, each block with at most two of its bits changed; a value that very many share is cut into shards too."""
    cut = lambda c, high: F.shiftrightunsigned(c, 32) if high else c.bitwiseAND(F.lit((1 << 32) - 1))
    blocks = F.array(*(F.struct(F.lit(k).alias("k"), cut(F.col(c), high).alias("v")) for k, (c, high) in enumerate((("hi", True), ("hi", False), ("lo", True), ("lo", False)))))
    flips = F.array(*(F.lit(f).cast("long") for f in _FLIPS))
    each = fps.withColumn("b", F.explode(blocks)).select("hi", "lo", "b.k", "b.v")
    spread = lambda df: df.withColumn("v", F.explode(F.transform(flips, lambda f: F.col("v").bitwiseXOR(f))))
    hot = spread(each.groupBy("k", "v").count().where(F.col("count") > shard)).groupBy("k", "v").agg(F.sum("count").alias("many"))
    hot = stored(hot.select("k", "v", F.ceil(F.col("many") / shard).cast("int").alias("parts")))
    met = spread(each)
    if small(hot, 0):
        met = met.withColumns({"at": F.lit(0), "s": F.lit(0), "t": F.lit(0)})
    else:
        met = met.join(maybe_broadcast(hot), ["k", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        met = met.withColumn("at", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.withColumns({"s": F.least("at", "other"), "t": F.greatest("at", "other")}).drop("other", "parts")
    buckets = max(1, -(-n * 4 * len(_FLIPS) // BUCKET))
    return met.withColumn("bucket", F.pmod(F.xxhash64("k", "v", "s", "t"), F.lit(buckets)))


_FOUND = "hi_a long, lo_a long, hi_b long, lo_b long, number long"


def _near(bits: np.ndarray, cell: np.ndarray, at: np.ndarray, s: np.ndarray, t: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of the near pairs of every cell: rows of equal ``cell``, which are side by side, in shards ``s`` and ``t`` of it."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(cell)))
    few = (size <= LEAF) & (s[begin] == t[begin])
    # small cells all at once: each row with the next, with the one after that, and so on
    i, step = np.flatnonzero(np.repeat(few, size)), 1
    while len(i):
        i = i[i + step < len(cell)]
        i = i[cell[i] == cell[i + step]]
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a = i[k : k + PAIRS_AT_ONCE]
            d = np.bitwise_count(bits[a, 0] ^ bits[a + step, 0])
            d += np.bitwise_count(bits[a, 1] ^ bits[a + step, 1])
            hit = d <= radius
            if hit.any():
                yield a[hit], a[hit] + step, d[hit].astype(np.int64)
        step += 1
    for b, n in zip(begin[~few].tolist(), size[~few].tolist()):
        rows = np.arange(b, b + n)
        data, query = rows[at[rows] == s[b]], rows[at[rows] == t[b]]
        if len(data) and len(query):
            sets, own = (bits[query], bits[data]), bool(s[b] == t[b])
            cut = cheapest_index(*sets, own, radius) if len(query) * len(data) >= INDEX_FROM else 0
            for x, y, d in indexed_pairs(*sets, own, radius, cut) if cut else shard_pairs(*sets, own, radius):
                yield query[x], data[y], d


def _meets_here(bits: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether block ``k`` is the first in which a pair differs in at most four bits, and ``v`` the value half way: so of all the cells in which a pair meets, one counts it."""
    blocks = lambda r: np.stack([bits[r, 0] >> np.uint64(32), bits[r, 0], bits[r, 1] >> np.uint64(32), bits[r, 1]], axis=1).astype(np.uint32)
    lesser = (bits[a, 0] < bits[b, 0]) | ((bits[a, 0] == bits[b, 0]) & (bits[a, 1] < bits[b, 1]))
    from_, to = blocks(np.where(lesser, a, b)), blocks(np.where(lesser, b, a))
    row = np.arange(len(a))
    diff = from_ ^ to
    first = (np.bitwise_count(diff) <= 4).argmax(axis=1)
    d = diff[row, first]
    half = np.bitwise_count(d) // 2
    one = d & (~d + np.uint32(1))
    rest = d ^ one
    two = rest & (~rest + np.uint32(1))
    change = np.where(half > 0, one, 0) | np.where(half > 1, two, 0)
    return (k == first) & (v.astype(np.uint32) == from_[row, first] ^ change.astype(np.uint32))


def _search(fps: DataFrame, radius: int, shard: int, forest: bool, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """Near pairs of distinct fingerprints (hi_a, lo_a, hi_b, lo_b, number: the distance), each once.

    If ``forest``, of every task only a spanning forest of its pairs; and, with hi_b and lo_b null, the number of pairs that a fingerprint (hi_a, lo_a) has in the task.
    """
    ship(fps.sparkSession)
    n = fps.count()
    by_block = n >= blocks_from and radius < 20
    met = _in_blocks(fps, n, shard) if by_block else _in_shards(fps, n, radius, min(max(-(-n // SHARDS), shard), LARGE * shard))
    names = ["k", "v", "s", "t"] if by_block else ["s", "t"]

    def task(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy() for c in names]
        order = np.lexsort(cols)
        cols = [c[order] for c in cols]
        at = table.column("at").to_numpy()[order]
        fp = np.stack([table.column(c).to_numpy()[order] for c in ("hi", "lo")], 1)
        bits = np.ascontiguousarray(fp).view(np.uint64)
        cell = np.cumsum(np.concatenate([[0], np.any([c[1:] != c[:-1] for c in cols], axis=0).astype(np.int64)])) if len(at) else np.zeros(0, np.int64)
        links, tree = np.zeros(len(at), np.int64), Forest(len(at))
        found: list[tuple] = []
        for a, b, d in _near(bits, cell, at, cols[-2], cols[-1], radius):
            if by_block:
                once = _meets_here(bits, a, b, cols[0][a], cols[1][a])
                a, b, d = a[once], b[once], d[once]
            if forest:
                tree.add(a, b, d)
                links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
            else:
                found.append((a, b, d))
        e = np.array(tree.edges, np.int64).reshape(-1, 3)
        a, b, d = (np.concatenate([e[:, i], *(f[i] for f in found)]).astype(np.int64) for i in range(3))
        who = np.flatnonzero(links)
        none = np.concatenate([np.zeros(len(a), bool), np.ones(len(who), bool)])
        left, right = fp[np.concatenate([a, who])], fp[np.concatenate([b, who])]
        released()
        return pa.table({"hi_a": left[:, 0], "lo_a": left[:, 1], "hi_b": pa.array(right[:, 0], mask=none), "lo_b": pa.array(right[:, 1], mask=none), "number": np.concatenate([d, links[who]])})

    return met.groupBy("bucket").applyInArrow(task, _FOUND)


def distinct_fingerprints(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each fingerprint of a ``fingerprint_table`` once: hi, lo, rows, and of its first row (null ids last, then by id, by hash of the text) the id and hash, ``best``."""
    row = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("__wl_key").alias("k"))
    return table.groupBy("hi", "lo").agg(F.count("*").alias("rows"), F.min(row).alias("best"))


def pairs(table: DataFrame, radius: int = RADIUS, shard: int = SHARD, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """All near pairs of distinct fingerprints of a ``fingerprint_table`` (hi_a, lo_a, hi_b, lo_b, distance), each once, in either order."""
    return _search(stored(table.select("hi", "lo").distinct()), radius, shard, False, blocks_from).withColumnRenamed("number", "distance")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); root: the least node that it is connected to.

    Alternates large-star and small-star steps, each stored, until nothing moves: O(log^2 n) rounds.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt = stored(star)
        # a fixed point: every node has one edge and no root is a node itself
        if small(nxt.groupBy("a").count().where("count > 1"), 0) and small(nxt.join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi"), 0):
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = nxt


def labelled(table: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shard: int = SHARD, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """hi, lo, rows, links (near fingerprints), keep (first row of the group: x, i, k) of every fingerprint that is in a group of at least two rows."""
    distinct = stored(distinct_fingerprints(table, id_col).withColumn("node", F.xxhash64("hi", "lo")))
    found = stored(_search(distinct.select("hi", "lo"), radius, shard, True, blocks_from))
    edges = found.where("hi_b is not null").select(F.xxhash64("hi_a", "lo_a").alias("a"), F.xxhash64("hi_b", "lo_b").alias("b"))
    links = found.where("hi_b is null").groupBy(F.col("hi_a").alias("hi"), F.col("lo_a").alias("lo")).agg(F.sum("number").alias("links"))
    comp = stored(components(edges))
    members = distinct.join(maybe_broadcast(comp), "node", "left").where(F.col("root").isNotNull() | (F.col("rows") > 1)).withColumn("root", F.coalesce("root", "node"))
    members = stored(members.join(maybe_broadcast(links), ["hi", "lo"], "left"))
    first = members.groupBy("root").agg(F.min("best").alias("keep"))
    return stored(members.join(maybe_broadcast(first), "root").select("hi", "lo", "rows", F.coalesce("links", F.lit(0)).alias("links"), "keep"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """One row per row of ``docs`` that has near duplicates or copies: id, group_id (least id of the group), n_links (other fingerprints within the radius), n_copies (rows of this very fingerprint).

    Null and empty texts are in no group; texts without words are only with exact copies.  Repeated rows are copies of each other
    and have a row each.  Null ids have a row too; group_id is null if the group has no other ids.  Groups are connected
    components: two members may be further apart than the radius.  An empty table has no groups.  Very long texts are taken whole.
    """
    table = stored(fingerprint_table(docs, id_col, text_col))
    named = labelled(table, id_col, radius, shard, blocks_from)
    return table.join(maybe_broadcast(named), ["hi", "lo"]).select(id_col, F.col("keep.i").alias("group_id"), F.col("links").alias("n_links"), F.col("rows").alias("n_copies"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """``docs`` with one row of each group: the one of least id (nulls last, then by hash of the text).

    Rows with null or empty texts stay, repeated ones too: they have no fingerprint.  Of repeated rows of a group's
    kept document one stays.  An empty table stays empty; columns of any name pass through.
    """
    table = stored(fingerprint_table(docs, id_col, text_col))
    named = labelled(table, id_col, radius, shard, blocks_from)
    marked = table.join(maybe_broadcast(named), ["hi", "lo"]).select(F.col(id_col).alias("__wl_id"), "__wl_key", (F.col(id_col).eqNullSafe(F.col("keep.i")) & (F.col("__wl_key") == F.col("keep.k"))).alias("keeper"))
    counted = stored(marked.groupBy("__wl_id", "__wl_key", "keeper").agg(F.count("*").alias("copies")))
    drop, more = (counted.where(c).select("__wl_id", "__wl_key") for c in ("not keeper", "keeper and copies > 1"))
    keyed = docs.withColumns({"__wl_k": F.xxhash64(F.col(text_col).cast("string"))})

    def without(df: DataFrame, gone: DataFrame, how: str) -> DataFrame:
        g = gone.select(F.col("__wl_id").alias("__wl_gi"), F.col("__wl_key").alias("__wl_gk"))
        return df.join(g, (df["__wl_k"] == g["__wl_gk"]) & df[id_col].eqNullSafe(g["__wl_gi"]), how)

    kept = without(keyed, maybe_broadcast(drop), "left_anti")
    if not small(more, 0):  # repeated rows of a kept document: rare, so only these are shuffled
        hint = maybe_broadcast(more)
        kept = without(kept, hint, "left_anti").unionByName(without(kept, hint, "left_semi").dropDuplicates([id_col, "__wl_k"]))
    return kept.select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Second stage of the corpus pipeline: one document of each group of near duplicates stays."""
    return deduplicate(docs)
