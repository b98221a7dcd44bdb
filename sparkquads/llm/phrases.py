"""Substring dedup by repeated-phrase automata.

Phrases that may recur are confirmed by their words, not their hashes, and compiled into Aho-Corasick automata, one for
each shard of the phrases. Texts around the phrases of a shard are streamed through its automaton, which locates every
occurrence. A shard takes a bounded number of phrases and a text goes only to the shards of phrases that it can hold
(the sampled positions depend on the phrase alone), so the work grows with the input and not with its square. Phrases
that very many documents hold go another way, see repeats.candidates.

Inside a shard a word is one character: the words of its phrases are numbered, all others share one number. A phrase
then takes PHRASE nodes, and the numbers stay below the number of code points as a shard's phrases are few enough.
"""

from __future__ import annotations

import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, partitions, pieces_of, slices
from .repeats import BACK, LENGTH, MOST_TASKS, PHRASE, SPANS, around, candidates, combined, hash_windows, intervals, merged, repeated
from .words import U, Words

#: Occurrences of phrases per shard, about; the distinct phrases are at most half as many.
SHARD = 40_000
#: Phrases in one automaton, so that their words can be numbered by code points.
MOST_PHRASES = 0x10F000 // PHRASE
#: Bytes of text that a task gathers before it sends them.
RUN_BYTES = 12 << 20


def _string(words: list[bytes], numbers: dict[bytes, int]) -> str:
    return np.array([numbers.get(w, 0) for w in words], "<u4").tobytes().decode("utf-32-le", "surrogatepass")


def automaton(phrases: list[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Of phrases that have the same number of words; it gives the number of each phrase it meets."""
    numbers: dict[bytes, int] = {}
    for p in phrases:
        for w in p:
            numbers.setdefault(w, len(numbers) + 1)
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        auto.add_word(_string(p, numbers), i)
    auto.make_automaton()
    return auto, numbers


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): the words, counted from 0, that lie in a passage of LENGTH words which another
    document has too; passages that touch are one span.

    Words are runs of anything but ASCII white space and are compared as they are. Null, empty and shorter texts have
    no spans. Rows of one doc_id, repeated or not, are one document, so they alone repeat nothing; a null doc_id is one
    document too and stays null. Other columns are not read.
    """
    texts, count, hot = candidates(docs)
    shards = max(partitions(docs.sparkSession) if count > SHARD else 1, parts_of(count, SHARD))

    def segments(batches):
        """Per shard the stretches of text within reach of one of its phrases, with the phrases' places in them."""
        squeeze = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(k, squeeze.compress(pickle.dumps(v, 5))) for k, v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "texts"])

        for batch in batches:
            for part in slices(batch):
                words, at, h = around(part)
                data, docno = words.buf.tobytes(), words.doc[at]
                doc = np.asarray(part.column(0))[docno]
                first, stop = words.first[docno], words.first[docno + 1]
                shard = (h % U(shards)).astype(np.int64)
                order = np.lexsort((at, shard))
                low, high = np.maximum(first, at - BACK)[order], np.minimum(stop, at + LENGTH)[order]
                at, doc, first, shard, docno = at[order], doc[order], first[order], shard[order], docno[order]
                if not len(at):
                    continue
                new = np.r_[True, (shard[1:] != shard[:-1]) | (docno[1:] != docno[:-1]) | (low[1:] > high[:-1])]
                begins = np.flatnonzero(new)
                ends = np.r_[begins[1:], len(at)]
                for b, e in zip(begins.tolist(), ends.tolist()):
                    lo, hi = int(low[b]), int(high[e - 1])
                    text = data[words.begin[lo] : words.end[hi - 1]]
                    held.setdefault(int(shard[b]), []).append((int(doc[b]), lo - int(first[b]), (at[b:e] - lo).tolist(), text))
                    size += len(text)
                if size > RUN_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def search(batches):
        unzip = zstandard.ZstdDecompressor()
        held, now = [], None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now and held:
                    yield located(held)
                    held = []
                now = k
                held += pickle.loads(unzip.decompress(blob.as_py()))
        if held:
            yield located(held)

    def located(held):
        split = [s[3].split() for s in held]
        holders: dict[bytes, tuple[int, int]] = {}
        for (doc, _, places, _), ws in zip(held, split):
            for i in places:
                p = b" ".join(ws[i : i + PHRASE])
                a, b = holders.get(p, (doc, doc))
                holders[p] = min(a, doc), max(b, doc)
        confirmed = [p.split(b" ") for p, (a, b) in holders.items() if a < b]
        row, place, phrase = [], [], []
        for i in range(0, len(confirmed), MOST_PHRASES):
            auto, numbers = automaton(confirmed[i : i + MOST_PHRASES])
            for j, ws in enumerate(split):
                for end, k in auto.iter(_string(ws, numbers)):
                    row.append(j)
                    place.append(end - PHRASE + 1)
                    phrase.append(i + k)
        row, place, phrase = (np.array(x, np.int64) for x in (row, place, phrase))
        doc = np.array([s[0] for s in held], np.int64)[row]
        offset = np.array([s[1] for s in held], np.int64)[row]
        order = np.argsort(row, kind="stable")
        window = np.zeros((BACK + 1, len(row)), U)  # hash of the passage that starts d words before, 0 if there is none
        for a, b in pieces_of([len(s[3]) for s in held]):
            words = Words(np.frombuffer(b"".join(s[3] for s in held[a:b]), np.uint8), np.cumsum([0, *(len(s[3]) for s in held[a:b])]))
            hashes = hash_windows(words, LENGTH)
            some = order[np.searchsorted(row, a, sorter=order) : np.searchsorted(row, b, sorter=order)]
            for d in range(BACK + 1):
                inside = some[place[some] >= d]
                window[d, inside] = hashes[words.first[row[inside] - a] + place[inside] - d]
        flags = np.zeros((BACK + 1, len(row)), bool)
        for d in range(BACK + 1):
            fits = np.flatnonzero(window[d])
            flags[d, fits] = repeated(combined(phrase[fits].astype(U), window[d, fits]), doc[fits])
        return intervals(doc, offset + place, flags)

    sent = texts.mapInArrow(segments, "shard long, texts binary")
    found = sent.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(search, SPANS)
    return merged(found.unionByName(hot))
