"""Benchmark decontamination by Wu-Manber search.

Test strings are all word n-grams of the benchmark items. A table of shifts by the hash of a block of bytes tells how
far the search may jump; where the shift is zero, the bucket of that block as a suffix gives the test strings that may
end there, and their bytes are compared. The search runs over many lanes of a buffer of texts at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh, from_ids, ids, slices, text_buffer

#: Words in a test string; an item with fewer is one test string.
NGRAM = 13
#: A document goes if it holds a test string of so many words; a word or two of a short item don't make it a copy.
LEAST = 5
#: Bytes of test strings in one broadcast; beyond it, shards of this size lie in the shared folder. A task then gathers
#: HELD_BYTES of text before it loads each shard in turn.
SHARD_BYTES, HELD_BYTES = 64 << 20, 64 << 20
_LANE = 2048
_END = 255  # no byte of UTF-8
_PLAIN = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_c] = _c


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of ASCII other than letters and digits as one blank, a blank at either end. Returns the bytes
    of all texts, each ended by _END, and the positions of these ends."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())
    framed = pc.binary_join_element_wise(pa.scalar(b"", low.type), low, pa.scalar(bytes([_END]), low.type), pa.scalar(b" ", low.type))
    buf, _ = text_buffer(framed)
    buf = _PLAIN[buf]
    keep = np.ones(len(buf), bool)
    blank = buf == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    buf = buf[keep]
    return buf, np.flatnonzero(buf == _END)


def test_strings(text: str | None, n: int = NGRAM, least: int = 1) -> list[bytes]:
    buf, ends = normalised(pa.array([text]))
    words = bytes(buf[: ends[0]]).split()
    if len(words) < least:
        return []
    n = min(n, len(words))
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)]


class WuManber:
    """Finds all occurrences of any of the patterns, which map to lists of ids."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.patterns = patterns
        self.names = list(patterns)
        self.m = min(map(len, self.names))
        self.block = min(8, self.m)
        self.mask = np.uint64(2 ** (8 * self.block) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.names), np.uint8).reshape(-1, self.m)
        far = self.m - self.block + 1
        self.bits = min(24, max(12, int(len(self.names) * far).bit_length() + 2))
        self.shift = np.full(1 << self.bits, min(far, 65535), np.uint16)
        for j in range(far):  # a later block allows the smaller shift
            self.shift[self.slot(self.blocks(heads, j))] = min(far - 1 - j, 65535)
        suffix = self.blocks(heads, far - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.order]

    def blocks(self, rows: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for b in range(self.block):
            out |= rows[:, j + b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, buf: np.ndarray) -> list[tuple[int, bytes]]:
        """Start and pattern of each occurrence."""
        n, m = len(buf), self.m
        if n < m:
            return []
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        at8 = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
        lanes = np.arange(m, n + 1, _LANE)
        stop = np.minimum(lanes + _LANE, n + 1)
        found = []
        while len(lanes):
            for _ in range(8):
                shift = self.shift[self.slot(at8[np.minimum(lanes, stop - 1) - self.block] & self.mask)]
                zero = shift == 0
                if zero.any():
                    zero &= lanes < stop
                    found.append(lanes[zero])
                lanes = lanes + np.maximum(shift, 1)
            live = lanes < stop
            lanes, stop = lanes[live], stop[live]
        if not found:
            return []
        ends = np.unique(np.concatenate(found))
        suffix = at8[ends - self.block] & self.mask
        lo, hi = np.searchsorted(self.suffixes, suffix, "left"), np.searchsorted(self.suffixes, suffix, "right")
        data, out = buf.tobytes(), []
        for e, a, b in zip(ends[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for k in self.order[a:b]:
                p = self.names[k]
                if data.startswith(p, e - m):
                    out.append((e - m, p))
        return out


@lru_cache(maxsize=1)
def _loaded(uri: str) -> list[WuManber]:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


class TestStrings:
    """Matchers of a benchmark, in broadcasts of bounded size or, beyond it, in files that are loaded one at a time."""

    __test__ = False

    def __init__(self, benchmark: DataFrame, n: int = NGRAM, shard_bytes: int = SHARD_BYTES, least: int = 1):
        spark, self.broadcast, self.files = benchmark.sparkSession, None, []
        patterns: dict[bytes, list[int]] = {}
        size, folder = 0, None
        rows = benchmark.select(ids("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
        for item, text in rows.toLocalIterator():
            for p in test_strings(text, n, least):
                items = patterns.setdefault(p, [])
                size += len(p) * (not items)
                if item not in items:
                    items.append(item)
            if size > shard_bytes:
                folder = folder or fresh(spark, "teststrings")
                self.files.append(self._file(folder, patterns))
                patterns, size = {}, 0
        if patterns and folder:
            self.files.append(self._file(folder, patterns))
        elif patterns:
            self.broadcast = spark.sparkContext.broadcast(self._matchers(patterns))

    @staticmethod
    def _matchers(patterns: dict[bytes, list[int]]) -> list[WuManber]:
        """Short test strings apart, as the shortest bounds the shifts."""
        classes: dict[int, dict[bytes, list[int]]] = {}
        for p, items in patterns.items():
            classes.setdefault(0 if len(p) < 8 else 1 if len(p) < 24 else 2, {})[p] = items
        return [WuManber(c) for c in classes.values()]

    def _file(self, folder: str, patterns: dict[bytes, list[int]]) -> str:
        fs, path = file_system(f"{folder}/{len(self.files)}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(pickle.dumps(self._matchers(patterns)))
        return f"{folder}/{len(self.files)}"

    def shards(self):
        if self.broadcast is not None:
            yield self.broadcast.value
        for uri in self.files:
            yield _loaded(uri)

    def search(self, parts: list[pa.Array]) -> list[list[tuple[int, int, int]]]:
        """Of each part, (text, item, number of the word at which it starts) of each occurrence. Every shard is loaded
        once for all the parts."""
        plain = [normalised(p) for p in parts]
        blanks: list[np.ndarray | None] = [None] * len(parts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
        for matchers in self.shards():
            for i, (buf, ends) in enumerate(plain):
                for matcher in matchers:
                    hits = matcher.find(buf)
                    if not hits:
                        continue
                    if blanks[i] is None:
                        blanks[i] = np.flatnonzero(buf == 32)
                    begins = np.array([h[0] for h in hits])
                    doc = np.searchsorted(ends, begins)
                    before = np.searchsorted(blanks[i], begins) - np.searchsorted(blanks[i], np.where(doc > 0, ends[doc - 1] + 1, 0))
                    for d, w, (_, p) in zip(doc.tolist(), before.tolist(), hits):
                        out[i] += [(d, item, w) for item in matcher.patterns[p]]
        return out

    def gathered(self, parts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int]]]]:
        """The parts with what is found in them: one by one with a broadcast, else by HELD_BYTES."""
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            held.append(part)
            size += part.column(column).nbytes
            if not self.files or size > HELD_BYTES:
                yield from zip(held, self.search([p.column(column) for p in held]))
                held, size = [], 0
        yield from zip(held, self.search([p.column(column) for p in held]))


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, hits, first_word) for each document row and benchmark item that share a test string: in how
    many places, and the number of the first such word, counted from 0 in the normalised text.

    Test strings are the item's runs of n words. An item of fewer words, down to one, is a test string as a whole. A null or empty text and a null item have no test strings. Null ids stay null. A repeated document row repeats its
    result, a repeated item row counts once. Other columns are not read. An empty table on either side gives no rows.
    """
    tests = TestStrings(benchmark, n, shard_bytes)

    def run(batches):
        for part, hits in tests.gathered((part for batch in batches for part in slices(batch)), 1):
            seen: dict[tuple[int, int], list[int]] = {}
            for d, item, w in hits:
                x = seen.setdefault((d, item), [0, w])
                x[0] += 1
                x[1] = min(x[1], w)
            doc = np.asarray(part.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in ([int(doc[d]) for d, _ in seen], [i for _, i in seen], [x[0] for x in seen.values()], [x[1] for x in seen.values()])],
                ["d", "i", "hits", "first_word"],
            )

    found = docs.select(ids("doc_id").alias("d"), F.col("text").cast("string").alias("text")).mapInArrow(run, "d long, i long, hits long, first_word long")
    return found.select(from_ids("d").alias("doc_id"), from_ids("i").alias("item_id"), "hits", "first_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, least: int = LEAST) -> DataFrame:
    """The rows of docs without those that hold a test string, in all their columns.

    Test strings are those of occurrences(), but items of fewer than `least` words have none here: a document is no
    copy of an item because it has its one word; least=1 takes them too. A null or empty text holds none, repeated rows
    go or stay together, null ids count like others, and an empty benchmark or table takes nothing away.
    """
    tests = TestStrings(benchmark, n, least=least)

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        at = 0
        for part, hits in tests.gathered(slices(pa.RecordBatch.from_arrays([texts], ["text"])), 0):
            out[[at + d for d, _, _ in hits]] = True
            at += part.num_rows
        return pa.array(out)

    return docs.where(~holds(F.coalesce(F.col("text").cast("string"), F.lit(""))))


ORACLE = f"""
with norm as (
  select doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') w from documents),
items as (
  select distinct item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') w from benchmark),
sized as (select item_id, w, least({NGRAM}, len(w)) n from items where w <> ['']),
grams as (
  select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') g from (select *, unnest(range(0, len(w) - n + 1)) i from sized)),
places as (
  select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') g
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) i from norm, (select distinct n from sized) where len(w) >= n))
select doc_id, item_id, count(*)::bigint hits, min(i)::bigint first_word from places join grams using (n, g) group by all
"""
