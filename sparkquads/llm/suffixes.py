"""Suffix-array dedup: a distributed merge sort of suffixes that never compares a known common prefix again.

Each task sorts the suffixes of its texts, cuts the sorted run at splitters, front-codes every piece (length of the
prefix shared with the suffix before, then the rest) and sends it to the splitter's bucket. A bucket merges its pieces
with a loser tree whose nodes hold the common prefix with the last winner, so comparisons start behind it. Neighbours
in the merged order give the longest common prefixes and with them the passages that two documents share.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, partitions, pieces_of, slices
from .repeats import BACK, LENGTH, MOST_TASKS, PHRASE, SMALL, SPANS, around, candidates, combined, intervals, merged, repeated
from .words import U, Words, anchors

#: Suffixes per bucket, about; buckets grow in number, not in size.
BUCKET = 40_000
#: Ranges at most, whose splitters every task holds. A range is divided further by the phrases' hashes: suffixes with a
#: phrase in common, which alone are compared, stay together and in order.
MOST_RANGES = 4096
#: Splitters come from about this many sampled suffixes per range; the sample only balances the ranges.
PER_RANGE = 8
#: Bytes of suffixes in a sorted run.
RUN_BYTES = 12 << 20


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            z = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m - (z.bit_length() + 7) // 8 if z else m)
        known += len(x)
        step *= 4
    return n


def front_coded(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of a sorted run: lengths of the prefix shared with the one before, and what follows it."""
    lcp, rest, last = [], [], b""
    for s in run:
        n = common_prefix(last, s)
        lcp.append(n)
        rest.append(s[n:])
        last = s
    return lcp, rest


def plain(lcp: list[int], rest: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, r in zip(lcp, rest):
        last = last[:n] + r
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the one before) of all strings in sorted order. A run is sorted and comes
    with its own shared prefixes. Ties go to the run with the lesser number."""
    runs_n = len(runs)
    k = 1
    while k < runs_n:
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - runs_n)
    shared = [r[1] for r in runs] + [[]] * (k - runs_n)
    place = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known = [0] * k  # prefix that each head shares with the last winner
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        n = common_prefix(x, y, p)
        if n == len(x) and n == len(y):
            if a > b:
                a, b = b, a
        elif n == len(y) or (n < len(x) and y[n] < x[n]):
            a, b = b, a
        known[b] = n
        return a, b

    winners = list(range(k))
    level = k
    while level > 1:
        half = level // 2
        nxt = []
        for i in range(half):
            w, loser[half + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(w)
        winners, level = nxt, half
    w = winners[0]
    while head[w] is not None:
        i = place[w]
        yield w, i, known[w]
        i += 1
        place[w] = i
        if i < len(strings[w]):
            head[w], known[w] = strings[w][i], shared[w][i]
        else:
            head[w] = None
        node = (k + w) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2


def _suffix(data: bytes, words: Words, at: int, stop: int) -> bytes:
    """Words from one to another, each followed by a blank."""
    return b" ".join(data[words.begin[at] : words.end[stop - 1]].split()) + b" "


def splitters(docs: DataFrame, ranges: int) -> list[bytes]:
    """Phrases that cut the sorted phrases of a sample of documents into equal parts."""
    if ranges < 2:
        return []
    wanted = ranges * PER_RANGE

    def phrases(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(0))
                at, h = anchors(words, PHRASE, SMALL)
                at = at[h % U(64) == 0]
                data = words.buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([_suffix(data, words, i, i + PHRASE) for i in at.tolist()], pa.binary())], ["p"])

    n = docs.count()
    share = min(1.0, wanted * 4 / max(1, n))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = sorted(r.p for r in some.mapInArrow(phrases, "p binary").distinct().orderBy(F.xxhash64("p")).limit(wanted).toLocalIterator())
    return sorted({bytes(found[len(found) * i // ranges]) for i in range(1, ranges)}) if found else []


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): the words, counted from 0, that lie in a passage of LENGTH words which another
    document has too; passages that touch are one span.

    Words are runs of anything but ASCII white space and are compared as they are. Null, empty and shorter texts have
    no spans. Rows of one doc_id, repeated or not, are one document, so they alone repeat nothing; a null doc_id is one
    document too and stays null. Other columns are not read.
    """
    texts, count, hot = candidates(docs)
    buckets = max(partitions(docs.sparkSession) if count > BUCKET else 1, parts_of(count, BUCKET))
    ranges = min(buckets, MOST_RANGES)
    classes = -(-buckets // ranges)
    # of bounded size: MOST_RANGES phrases
    cuts = docs.sparkSession.sparkContext.broadcast(splitters(docs, ranges))

    def runs(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[tuple[bytes, int, int, int, bytes, int]] = []
        size = 0

        def flush():
            held.sort()
            pieces: dict[int, list] = {}
            at = [bisect_right(cuts.value, h[0][: h[3]]) * classes + h[5] for h in held]
            for b, h in zip(at, held):
                pieces.setdefault(b, []).append(h)
            out = []
            for b, hs in pieces.items():
                lcp, rest = front_coded([h[0] for h in hs])
                blob = pickle.dumps((np.array(lcp, np.int32), rest, np.array([h[1] for h in hs], np.int64), np.array([h[2] for h in hs], np.int64), [h[4] for h in hs]), 5)
                out.append((b, squeeze.compress(blob)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "run"])

        for batch in batches:
            for part in slices(batch):
                words, at, h = around(part)
                data, docno = words.buf.tobytes(), words.doc[at]
                doc = np.asarray(part.column(0))[docno]
                first, stop = words.first[docno], words.first[docno + 1]
                for a, d, lo, hi, c in zip(at.tolist(), doc.tolist(), first.tolist(), stop.tolist(), (h % U(classes)).tolist()):
                    s = _suffix(data, words, a, min(hi, a + LENGTH))
                    back = _suffix(data, words, max(lo, a - BACK), a) if a > lo else b""
                    key = int(words.end[a + PHRASE - 1] - words.begin[a]) + 1
                    if s.count(b" ", 0, key) != PHRASE:  # several blanks between words
                        key = len(_suffix(data, words, a, a + PHRASE))
                    held.append((s, d, a - lo, key, back, c))
                    size += len(s) + len(back)
                if size > RUN_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def bucket(batches):
        unzip = zstandard.ZstdDecompressor()
        pieces, now = [], None
        for batch in batches:
            for b, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now and pieces:
                    yield spans(pieces)
                    pieces = []
                now = b
                pieces.append(pickle.loads(unzip.decompress(run.as_py())))
        if pieces:
            yield spans(pieces)

    def spans(pieces):
        strings = [plain(p[0].tolist(), p[1]) for p in pieces]
        order = list(merge([(s, p[0].tolist()) for s, p in zip(strings, pieces)]))
        n = len(order)
        lcp, size = np.zeros(n, np.int16), np.zeros(n, np.int16)
        doc, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        backs = []
        for j, (r, i, shared) in enumerate(order):
            s = strings[r][i]
            lcp[j], size[j] = s.count(b" ", 0, shared), s.count(b" ")
            p = pieces[r]
            doc[j], at[j] = p[2][i], p[3][i]
            backs.append(p[4][i])
        had, back = np.zeros(n, np.int64), np.zeros((BACK + 1, n), U)
        for a, b in pieces_of([len(x) for x in backs]):
            before = Words(np.frombuffer(b"".join(backs[a:b]), np.uint8), np.cumsum([0, *map(len, backs[a:b])]))
            had[a:b] = np.diff(before.first)
            for d in range(1, BACK + 1):
                rows = np.flatnonzero(had[a:b] >= d)
                back[d, a + rows] = before.grams(d)[before.first[rows + 1] - d]
        flags = np.zeros((BACK + 1, n), bool)
        for d in range(BACK + 1):
            fits = np.flatnonzero((size >= LENGTH - d) & (had >= d))
            same = np.cumsum(lcp < LENGTH - d)[fits].astype(U)
            flags[d, fits] = repeated(combined(same, back[d, fits]) if d else same, doc[fits])
        return intervals(doc, at, flags)

    sent = texts.mapInArrow(runs, "bucket long, run binary")
    found = sent.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(bucket, SPANS)
    return merged(found.unionByName(hot))
