"""Near duplicates by SetSketch registers.

A text is the set of its word shingles. Every shingle makes points of a Poisson process, each with a time and one of M
registers; a register keeps the least time, whose logarithm to the base B, truncated, is its value. So registers are
minima that merge by maximum and agree in two sets with a probability close to their Jaccard similarity.

Bands of register values put sets into buckets. First each set is verified, by its shingles, against the least set of
most of its buckets, and what is similar is linked, so thousands of copies take thousands of comparisons and not their
square. Then what shares a bucket and isn't linked yet is compared jointly by maximum likelihood over all registers, in
blocks of bounded size, and pairs that may be similar are verified by their shingles. Only verified pairs are links; a
group is what chains of them connect. So unrelated texts that share boilerplate, and with it buckets, are never gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, from_ids, ids, slices, written
from .words import U, Words, mix

SHINGLE = 3
#: Least Jaccard similarity of a verified pair.
THRESHOLD = 0.5
#: A pair of similarity J is a candidate with probability 1 - (1 - J^WIDTH)^BANDS, 0.907 at the threshold.
BANDS, WIDTH = 75, 5
M = BANDS * WIDTH
#: Parameters of the sketch: base of the truncated logarithm, rate, largest register value.
B, RATE, TOP = 1.001, 20.0, 65535
#: How far below the threshold an estimate may be to be verified, three standard errors.
SLACK = 3 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / M)
#: Registers that a pair is first compared by, and how many of them must agree: 4.9 standard errors below the threshold.
FEW, FEW_SAME = 96, 24
#: Sets of a bucket in one block, and sets of a label in one unit of verification, about; a task holds two of either.
BLOCK, UNIT = 2048, 256
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each, and where those of each text begin. A text of
    fewer words than a shingle has one shingle of all its words."""
    n = np.diff(words.first)
    doc, parts = words.doc, []
    at = np.flatnonzero(words.whole(SHINGLE))
    parts.append((doc[at], words.grams(SHINGLE)[at]))
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        parts.append((short, mix(words.grams(k)[words.first[short]] + U(k))))
    doc, h = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Register values of each set, M in a row; of an empty set all are 0."""
    n = len(first) - 1
    least = np.full(n * M, np.inf)
    doc, x, j = np.repeat(np.arange(n), np.diff(first)), np.zeros(len(h)), 0
    while len(h):
        more = int(np.clip(16384 // len(h), 1, 32))  # points at once
        step = (np.arange(j, j + more, dtype=U) * U(_STEP))[:, None]
        s = mix(h[None, :] + step)
        u = ((mix(s + U(0x5851F42D4C957F2D)) >> U(11)).astype(np.float64) + 0.5) / 2.0**53
        times = x + np.cumsum(-np.log(u), axis=0) / (M * RATE)
        slot = doc * M + (((s >> U(32)) * U(M)) >> U(32)).astype(np.int64)
        np.minimum.at(least, slot.ravel(), times.ravel())
        x, j = times[-1], j + more
        live = np.flatnonzero(np.diff(doc, prepend=-1))
        reach = np.zeros(n)
        reach[doc[live]] = least.reshape(n, M)[doc[live]].max(axis=1)
        alive = x < reach[doc]
        h, doc, x = h[alive], doc[alive], x[alive]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / math.log(B))
    return np.clip(value, 0, TOP).astype(np.uint16).reshape(n, M)


def bands(regs: np.ndarray) -> np.ndarray:
    """Hash of each band, with the band's number in it."""
    r = regs.reshape(len(regs), BANDS, WIDTH).astype(U)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), r.shape[:2])
    for i in range(WIDTH):
        out = mix(out + (r[:, :, i] + U(1)) * U(_STEP))
    return out


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set, of its shingles alone."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(_STEP)))])
    return mix(total[first[1:]] - total[first[:-1]]).view(np.int64)


def estimate(one: np.ndarray, n: int, others: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Jaccard similarities of one set with others that maximise the likelihood of how many registers are larger,
    smaller and equal, given the sizes of the sets."""
    up, down = (one > others).sum(axis=1), (one < others).sum(axis=1)
    same = M - up - down
    u = n / (n + ns)
    v = 1 - u
    c = (B - 1) / B
    low, high = np.zeros(len(ns)), np.minimum(u / v, v / u) * (1 - 1e-9)
    for _ in range(24):  # the likelihood is concave
        j = (low + high) / 2
        a, b = 1 - c * (u - v * j), 1 - c * (v - u * j)
        p, q = -np.log(a), -np.log(b)
        rest = np.maximum(math.log(B) - p - q, 1e-12)
        slope = same * (v / a + u / b) / rest - up * v / (a * np.maximum(p, 1e-15)) - down * u / (b * np.maximum(q, 1e-15))
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(others)
    starts = np.cumsum([0, *map(len, others)])[:-1]
    common = np.add.reduceat(np.isin(every, one, assume_unique=False).astype(np.int64), starts)
    size = np.array([len(o) for o in others])
    return common / (len(one) + size - common)


def matching(regs: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with different labels, and of different blocks if there are two, that may be similar by the joint
    likelihood of all their registers. Most pairs end at their first registers."""
    two, left, right = block[0] != block[-1], [], []
    for i in range(len(regs) - 1):
        j = np.arange(i + 1, len(regs))
        fits = (label[j] != label[i]) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
        if two:
            fits &= block[j] != block[i]
        j = j[fits]
        if len(j):
            j = j[(regs[j, :FEW] == regs[i, :FEW]).sum(axis=1) >= FEW_SAME]
        if len(j):
            j = j[estimate(regs[i], size[i], regs[j], size[j]) >= threshold - SLACK]
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def linked(edges: DataFrame) -> DataFrame:
    """(k, root) for edges (a, b): root is the least node of the component. Alternates the large star and the small star
    of each node until nothing changes, which takes about as many rounds as the logarithm of the longest path."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, before = written(small.where("a <> b").distinct(), "edges"), edges
        dropped(before)
    return edges.select(F.col("a").alias("k"), F.col("b").alias("root"))


def rooted(parents: DataFrame) -> DataFrame:
    """(k, root) for (k, m), m being less than k and k unique: where following m ends. Each round doubles the steps."""
    now = written(parents.select("k", F.col("m").alias("root")), "roots")
    while True:
        up = now.select(F.col("k").alias("j"), F.col("root").alias("up"))
        further = written(now.join(up, F.col("root") == F.col("j"), "left").select("k", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = further
        if now.where("moved").isEmpty():
            return now.select("k", "root")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), the labels la and lb, of the pairs (a, b, la, lb, unit) whose shingles are similar, of each two labels in
    a unit one. A unit's texts go to one task, each once; whoever makes the units bounds them."""
    sides = pairs.select("unit", F.col("a").alias("k")).unionByName(pairs.select("unit", F.col("b").alias("k"))).distinct()
    none = F.lit(0).cast("long")
    rows = sides.join(texts.select("k", "text"), "k").select("unit", F.lit(0).alias("kind"), F.col("k").alias("a"), none.alias("b"), none.alias("la"), none.alias("lb"), "text")
    rows = rows.unionByName(pairs.select("unit", F.lit(1).alias("kind"), "a", "b", "la", "lb", F.lit(None).cast("string").alias("text")))

    def check(batches):
        now, sets = None, {}
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(Words.of(part.column(6)))
                out = []
                for i, (unit, kind, a, b, la, lb) in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)))):
                    if unit != now:
                        now, sets, done = unit, {}, set()
                    if not kind:
                        sets[a] = h[first[i] : first[i + 1]].copy()
                    elif (la, lb) not in done and jaccard(sets[a], [sets[b]])[0] >= THRESHOLD:
                        done.add((la, lb))
                        out.append((la, lb))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "kind", "a").mapInArrow(check, "a long, b long")


def _text() -> Column:
    return F.col("text").cast("string")


def _decisions(docs: DataFrame) -> DataFrame:
    """(d, t, rows, leader, copies) of each distinct id and text hash in a group of two rows or more; leader is (d, t)."""
    slim = docs.select(ids("doc_id").alias("d"), _text().alias("text")).where("text is not null").withColumn("t", F.xxhash64("text"))

    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(Words.of(part.column(1)))
                some = np.flatnonzero(np.diff(first))
                got = bands(registers(h, first)[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(some)),
                        part.column(2).take(pa.array(some)),
                        pa.array(set_keys(h, first)[some]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, BANDS, dtype=np.int32)), pa.array(got.view(np.int64).ravel())),
                    ],
                    ["d", "t", "k", "bands"],
                )

    sketches = written(slim.mapInArrow(sketch, "d long, t long, k long, bands array<long>"), "sketches")
    rows = sketches.groupBy("k", "d", "t").agg(F.count("*").alias("rows"))

    # cells (h, k, m): sets of a bucket of two or more, m being the least of them
    cells = sketches.select("k", F.explode("bands").alias("h"))
    least = cells.groupBy("h").agg(F.min("k").alias("m"), F.max("k").alias("most")).where("m < most").select("h", "m")
    cells = written(cells.join(least, "h").select("h", "k", "m").distinct(), "cells")
    texts = sketches.groupBy("k").agg(F.min(F.struct("d", "t")).alias("r")).join(cells.select("k").distinct(), "k", "left_semi")
    texts = slim.join(texts.select("k", F.col("r.d").alias("d"), F.col("r.t").alias("t")), ["d", "t"]).groupBy("k").agg(F.min("text").alias("text"))
    texts = written(texts.mapInArrow(_with_registers, "k long, n long, regs binary, text string"), "texts")

    # each set against the least set of most of its buckets
    best = cells.where("k <> m").groupBy("k", "m").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", F.bitwise_not("m").alias("m"))).alias("x"))
    best = written(best.select(F.col("k").alias("a"), F.bitwise_not("x.m").alias("b")), "best")
    spread = best.groupBy("b").agg(F.ceil(F.count("*") / UNIT).alias("salts"))
    pairs = best.join(spread, "b").select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"), F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("salts"))).alias("unit"))
    roots = rooted(verified(pairs, texts).select(F.col("a").alias("k"), F.col("b").alias("m")))

    # what is in one bucket and not linked yet, all against all by registers, in blocks of bounded size
    labels = texts.select("k").join(roots, "k", "left").select("k", F.coalesce("root", "k").alias("l"))
    spread = labels.groupBy("l").agg(F.ceil(F.count("*") / UNIT).alias("salts"))
    labels = written(labels.join(spread, "l").select("k", "l", F.xxhash64("l", F.pmod(F.xxhash64("k"), F.col("salts"))).alias("part")), "labels")
    cells = cells.select("h", "k").join(labels, "k")
    mixed = cells.groupBy("h").agg(F.min("l").alias("low"), F.max("l").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high").select("h", "blocks")
    cells = cells.join(mixed, "h").withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("k", "l", "part", "i", F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))
    cells = cells.join(texts.select("k", "n", "regs"), "k").select("unit", "i", "k", "l", "part", "n", "regs")
    pairs = cells.repartition("unit").sortWithinPartitions("unit", "i").mapInArrow(_matched, "a long, b long, la long, lb long, unit long").distinct()
    more = linked(verified(written(pairs, "pairs"), texts))
    labels = labels.join(more.withColumnRenamed("k", "l"), "l", "left").select("k", F.coalesce("root", "l").alias("g"))

    found = written(rows.join(labels, "k", "left").select("d", "t", "rows", F.coalesce("g", "k").alias("g")), "groups")
    leaders = found.groupBy("g").agg(F.min(F.struct("d", "t")).alias("leader"), F.sum("rows").alias("copies")).where("copies > 1")
    return found.join(leaders, "g").select("d", "t", "rows", "leader", "copies")


def _with_registers(batches):
    """(k, n, regs, text) of (k, text), n being the number of shingles."""
    for batch in batches:
        for part in slices(batch):
            h, first = shingle_sets(Words.of(part.column(1)))
            regs = registers(h, first)
            places = np.arange(0, regs.nbytes + 1, regs[:1].nbytes, dtype=np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(regs), [None, pa.py_buffer(places), pa.py_buffer(regs.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), blobs, part.column(1)], ["k", "n", "regs", "text"])


def _matched(batches):
    """Pairs of (unit, i, k, l, part, n, regs) that may be similar, with labels and the unit of their verification."""

    def pairs(rows: list[np.ndarray]):
        block, k, label, part, size, regs = (np.concatenate(x) for x in zip(*rows))
        a, b = matching(regs, size, label, block)
        swap = part[a] > part[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        unit = mix(mix(part[a].view(U)) + part[b].view(U)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[a], k[b], label[a], label[b], unit)], ["a", "b", "la", "lb", "unit"])

    now, held = None, []
    for batch in batches:
        unit = np.asarray(batch.column(0))
        cols = [np.asarray(batch.column(c)) for c in range(1, 6)] + [np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint16).reshape(-1, M)]
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if unit[a] != now and held:
                    yield pairs(held)
                    held = []
                now = unit[a]
                held.append(tuple(c[a:b] for c in cols))
    if held:
        yield pairs(held)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every row of docs that is in a group of two or more.

    Two rows are similar if the Jaccard similarity of their shingles, SHINGLE words as they are, is THRESHOLD at least;
    groups are what chains of similar rows link. The row of the least id stays (a null one is the least, ties go by the
    text's hash) and its id is the group's. Repeated rows are in a group, each with a row; keep then is true for all
    rows equal to the one that stays. Texts that are null or without words are in no group. Other columns are not read.
    An empty table gives no rows.
    """
    found = _decisions(docs)
    keep = (F.col("d") == F.col("leader.d")) & (F.col("t") == F.col("leader.t"))
    out = found.select(from_ids("d").alias("doc_id"), from_ids("leader.d").alias("group_id"), F.col("copies").alias("group_size"), keep.alias("keep"), "rows")
    return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "i")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs in all their columns, of each group one: the row of the least id, ties by the text's hash, and
    of repeated rows any. Texts that are null or without words stay, all of them."""
    found = _decisions(docs)
    gone = found.select("d", "t", ((F.col("d") == F.col("leader.d")) & (F.col("t") == F.col("leader.t"))).alias("keep"))
    rows = docs.select(F.struct("*").alias("row"), ids("doc_id").alias("d"), F.coalesce(F.xxhash64(_text()), F.lit(0)).alias("t"))
    rows = rows.join(gone, ["d", "t"], "left")
    one = rows.where("keep").groupBy("d", "t").agg(F.first("row").alias("row"))
    return rows.where("keep is null").select("row.*").unionByName(one.select("row.*"))
