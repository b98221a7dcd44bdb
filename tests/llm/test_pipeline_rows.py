"""run() against the same stages in plain Python, which share only their parameters with the package."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import zstandard

import corpus_pipeline
from sparkquads.llm import decontaminate, hashtree, langid, mixing, setsketch

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")


def drawn(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:13], 16)


def by_id(row):
    return (row[0] is not None, row[0] or 0)


def compressor(texts: list[str]):
    """Of the texts of a language, each up to an equal share of what is left, from the shortest on, and of a longer one
    pieces at equal distances, without bytes of characters that are cut."""
    room, parts = langid.DICTIONARY_BYTES, []
    for i, t in enumerate(sorted((t.lower().encode() for t in texts), key=lambda t: (len(t), t))):
        share = room // (len(texts) - i)
        if len(t) > share:
            n = max(1, share // langid.SEGMENT)
            cut = [t[len(t) * k // n : len(t) * k // n + share // n] for k in range(n)]
            parts.append(b"\n".join(c.decode(errors="ignore").encode() for c in cut))
            room -= share
        else:
            parts.append(t)
            room -= len(t)
    known = zstandard.ZstdCompressionDict(b"\n".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=langid.LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def languages(rows):
    """(language or None, margin) of each row."""
    labelled: dict[str, dict] = {}
    for i, text, lang, _, _ in rows:
        if text and lang:
            labelled.setdefault(lang, {})[i, text] = text
    assert len(labelled) > 1 and all(len(t) <= langid.SAMPLE_DOCS for t in labelled.values())
    compressors = {lang: compressor(list(t.values())) for lang, t in sorted(labelled.items())}

    def found(text):
        data = (text or "").lower().encode()
        if not data:
            return None, 0.0
        n = max(1, -(-len(data) // langid.PIECE))
        pieces = [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]
        (first, lang), (second, _) = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors.items())[:2]
        margin = (second - first) / first
        return lang if margin >= langid.MARGIN else None, margin

    return [found(r[1]) for r in rows]


def language_id(rows):
    return [r for r, (lang, _) in zip(rows, languages(rows)) if lang]


def test_languages_of_plain_python(spark):
    """op6 by brute force: of all rows of a small table, awkward ones and ties included, the language and the margin."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(None, None, "en", None, None), (1, "", "de", "s", 0), (2, "1234567890", None, "s", 10), (2, "1234567890", None, "s", 10), (3, "x", "", "s", 1), (None, "the thing", "en", "s", 9)]
    want = Counter((r[0], lang, round(margin, 6)) for r, (lang, margin) in zip(rows, languages(rows)))
    got = langid.identified(spark.createDataFrame(rows, docs.schema)).select("doc_id", "language", "margin").collect()
    assert Counter(map(tuple, got)) == want and len({lang for _, lang, _ in want}) == 5
    single = spark.createDataFrame([r for r in rows if r[2] == "de"], docs.schema)
    assert {(r.language, r.margin) for r in langid.identified(single).where("text <> ''").collect()} == {("de", 1.0)}
    twins = spark.createDataFrame([(1, "equal text", "bb", "s", 1), (1, "equal text", "aa", "s", 1)], docs.schema)
    assert {(r.language, r.margin) for r in langid.identified(twins).collect()} == {(None, 0.0)}


def near_dedup(rows):
    def shingles(text):
        w, k = WORDS.findall(text), setsketch.SHINGLE
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= setsketch.THRESHOLD * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least: dict[int, tuple] = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, r), r, key=by_id)
    return list(least.values())


def decontamination(rows, items):
    plain = lambda text: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).split(" ")
    strings = set()
    for text in items:
        w = [x for x in plain(text or "") if x]
        n = min(decontaminate.NGRAM, len(w))
        if len(w) >= decontaminate.LEAST:
            strings |= {" " + " ".join(w[i : i + n]) + " " for i in range(len(w) - n + 1)}
    texts = [" " + " ".join(x for x in plain(r[1]) if x) + " " for r in rows]
    return [r for r, t in zip(rows, texts) if not any(s in t for s in strings)]


def mixture(rows):
    chars = lambda r: r[4] if r[4] is not None else len(r[1] or "")
    size = Counter()
    for r in rows:
        size[r[3]] += chars(r)
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items() if n > 0}
    out = []
    for s, w in weight.items():
        e = math.floor(mixing.ONE * mixing.EPOCHS * (w / sum(weight.values())) * (sum(size.values()) / size[s]) + 0.5)
        reach = drawn(f"{mixing.SEED}/{'null' if s is None else s}") % mixing.ONE
        for r in sorted((r for r in rows if r[3] == s), key=by_id):
            reach += e
            out += [r] * (reach // mixing.ONE - (reach - e) // mixing.ONE)
    return out


def sharding(rows):
    out = []
    for r in rows:
        below, path, key = hashtree.TREE, [], "null" if r[0] is None else str(r[0])
        while below:
            name = min(below, key=lambda n: -math.log((drawn("\x1f".join([*path, n, key])) + 0.5) / 2**52) / below[n][0])
            path.append(name)
            below = below[name][1]
        out.append((*r, *path))
    return out


def fixture(docs, items):
    """docs with null and empty texts, exact and near copies, a null id, source and size, and two mixed texts that hold
    13 and 12 words of an item."""
    long = sorted((r for r in docs if r[2] == "en" and len((r[1] or "").split()) > 150), key=by_id)
    base, rnd = long[0], random.Random(1)
    some = base[1].split()
    near = [*some[:20], "changed", *some[21:]]
    item = next(w for w in map(str.split, items) if len(w) >= 14)

    def mixed(doc, n):
        w = doc[1].split()
        rnd.shuffle(w)
        return " ".join(w[:60] + item[:n] + w[60:])

    more = [(10_001, None), (10_002, ""), (10_003, base[1]), (10_003, base[1]), (10_004, " ".join(near)), (10_005, mixed(long[1], 13)), (10_006, mixed(long[2], 12)), (None, mixed(long[3], 0)), (10_007, mixed(long[4], 0))]
    return docs + [(i, t, "en", None if i == 10_007 else base[3], None if i in (10_001, 10_006) else len(t)) for i, t in more]


def test_run_gives_the_rows_of_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    rows = fixture([tuple(r) for r in docs.collect()], items)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")

    known = language_id(rows)
    single = near_dedup(known)
    clean = decontamination(single, items)
    want = sharding(mixture(clean))
    assert len(rows) > len(known) > len(single) > len(clean)
    ids = {r[0] for r in clean}
    assert {10_006, 10_007, None} <= ids and not {10_001, 10_002, 10_003, 10_004, 10_005} & ids
    assert len({r[-3:] for r in want}) > 10 and len({r[0] for r in want}) < len(want)
    got = corpus_pipeline.run(spark, f"{tmp_path}")
    assert got.columns == [*corpus_pipeline.COLUMNS, *hashtree.LEVELS]
    assert Counter(map(tuple, got.collect())) == Counter(want)
