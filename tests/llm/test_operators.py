"""Each operator over awkward tables and against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from sparkquads.llm import decontaminate, hashtree, hostrules, langid, lines, mixing, phrases, repeats, setsketch, suffixes, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, d long, h long, s string, language int, copy string, shard string, bands string"


def table(spark, rows):
    """Rows (id, text, source, lang) in a table with columns that clash with names used inside the operators."""
    full = [(i, t, lg, src, None if t is None else len(t), "r", 1, 2, "x", 3, "y", "z", "b") for i, t, src, lg in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, most=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(most)}x" for _ in range(n)]


def awkward():
    """Null, empty and blank texts, null ids, repeated rows, a very long text, one id with two texts."""
    long = " ".join(words(1, 60_000))
    return [
        (None, None, None, None),
        (1, None, "a", "en"),
        (2, "", "a", "en"),
        (3, " \n\t\n\n ", "b", "de"),
        (4, "one", None, "en"),
        (5, "one two", "b", None),
        (5, "one two", "b", None),
        (5, "another text of the same id", "b", "de"),
        (None, "one two", "b", "en"),
        (6, long, "b", "en"),
        (7, long + " end", "c", "de"),
        (-(2**62), "line\nline\nline\nline", "c", ""),
        (2**62, "é 😀 ok\r\n\x0bdone", "c", "fr"),
    ]


def copies():
    """Texts of which some are near copies and some share passages of more than 50 words."""
    r, out = random.Random(5), []
    for k in range(12):
        base = words(100 + k, 120)
        out.append((len(out), " ".join(base)))
        for _ in range(k % 4):
            w = list(base)
            for _ in range(r.randrange(1, 8)):
                w[r.randrange(len(w))] = "changed"
            out.append((len(out), "  ".join(w)))
    passage = words(7, 70)
    for k in range(4):
        out.append((len(out), " ".join(words(200 + k, 80) + passage[k:] + words(300 + k, 80))))
    out.append((len(out), " ".join(words(200, 49))))
    return [(i, t, f"s{i % 3}", "en") for i, t in out]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(rows):
    """The rows' numbers by group: components of pairs at the threshold."""
    sets = [shingles(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= setsketch.THRESHOLD * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def test_near_duplicates(spark):
    """The partition into groups, their sizes and which row stays, against all pairs."""
    rows = awkward() + [(1000 + i, t, s, lg) for i, t, s, lg in copies()]
    groups = [g for g in brute_groups(rows) if len(g) > 1]
    docs = table(spark, rows)
    got = setsketch.near_duplicates(docs).collect()
    by_id = lambda i: (i is not None, i or 0)
    want = Counter()
    for g in groups:
        members = [rows[i][0] for i in g]
        for m in members:
            want[m, min(members, key=by_id), len(g)] += 1
    assert len(groups) > 8 and Counter((r.doc_id, r.group_id, r.group_size) for r in got) == want
    for g in groups:
        least = min((rows[i][0] for i in g), key=by_id)
        assert {r.doc_id for r in got if r.group_id == least and r.keep} == {least}
    left = setsketch.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - sum(len(g) - 1 for g in groups)
    assert setsketch.deduplicated(left).count() == left.count()
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0 and setsketch.deduplicated(docs.limit(0)).count() == 0


def test_chains_and_unrelated_texts_that_share_boilerplate(spark, monkeypatch):
    """Texts half of which are alike, so that they share buckets but are no copies; chains whose ends aren't similar;
    blocks and units of a few sets."""
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    monkeypatch.setattr(setsketch, "UNIT", 2)
    boiler = words(11, 60)
    rows = [(i, " ".join(boiler + words(1000 + i, 70)), "s", "en") for i in range(150)]
    chain = words(12, 80)
    for k in range(12):
        rows.append((500 + k, " ".join(chain), "s", "en"))
        chain = chain[9:] + words(2000 + k, 9)
    rows += [(600 + k, rows[3][1] + f" end{k}", "s", "en") for k in range(9)]
    want = {frozenset(rows[i][0] for i in g) for g in brute_groups(rows) if len(g) > 1}
    got: dict = {}
    for r in setsketch.near_duplicates(table(spark, rows)).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    assert {frozenset(g) for g in got.values()} == want and sorted(map(len, want)) == [10, 12]


def test_words_that_differ_only_in_a_thue_morse_pattern_hash_apart():
    from sparkquads.llm.words import Words

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    found = Words.of(pa.array([a, a.translate(str.maketrans("ab", "ba")), "word", "word\0", "a" * 8 + "b" * 8, "b" * 8 + "a" * 8, a])).hash
    assert len(set(found.tolist())) == 6 and found[0] == found[6]


def test_thousands_of_copies_are_one_group(spark):
    base = words(3, 60)
    docs = table(spark, [(i, " ".join(base[:30] + [f"n{i % 40}"] + base[30:]), "s", "en") for i in range(2000)])
    got = setsketch.near_duplicates(docs)
    assert got.count() == 2000 and got.where("keep").count() == 1 and {r.group_id for r in got.select("group_id").distinct().collect()} == {0}


def test_isolated_pairs_at_the_threshold_are_candidates():
    """1,500 pairs of sets of 90 shingles that share 60 of 120, by the bands alone."""
    import numpy as np

    from sparkquads.llm.words import mix

    pairs, h = 1500, []
    for k in range(pairs):
        x = mix(np.arange(120 * k, 120 * k + 120, dtype=np.uint64))
        h += [np.sort(x[:90]), np.sort(np.r_[x[:60], x[90:]])]
    found = setsketch.bands(setsketch.registers(np.concatenate(h), np.arange(2 * pairs + 1) * 90))
    shared = (found[0::2] == found[1::2]).any(axis=1).mean()
    assert setsketch.THRESHOLD == 60 / 120 and shared >= 0.9


def test_estimates_are_close():
    import numpy as np

    from sparkquads.llm.words import mix

    for share in (0.2, 0.5, 0.9):
        n = 4000
        common = int(2 * n * share / (1 + share))
        a, b = np.arange(n), np.r_[np.arange(common), np.arange(10**6, 10**6 + n - common)]
        h = [np.sort(mix(x.astype(np.uint64))) for x in (a, b)]
        regs = setsketch.registers(np.concatenate(h), np.array([0, n, 2 * n]))
        assert abs(setsketch.estimate(regs[0], n, regs[1:], np.array([n]))[0] - share) < 0.1
        both = setsketch.registers(np.unique(np.concatenate(h)), np.array([0, 2 * n - common]))
        assert (np.maximum(regs[0], regs[1]) == both[0]).all()


@pytest.mark.parametrize("module, small", [(phrases, False), (suffixes, False), (phrases, True), (suffixes, True)])
def test_repeated_passages(spark, module, small, monkeypatch):
    """Also with tiny shards, ranges and tasks, and with phrases that more than three documents hold going apart."""
    if small:
        monkeypatch.setattr(repeats, "HOT", 3)
        for name, value in {"SHARD": 5, "BUCKET": 5, "MOST_RANGES": 3, "MOST_TASKS": 4, "MOST_PHRASES": 2}.items():
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    rows = awkward() + [(1000 + i, t, s, lg) for i, t, s, lg in copies()]
    where: dict[tuple, set] = {}
    for i, t, _, _ in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {}
    for i, t, _, _ in rows:
        w = (t or "").split()
        hit = {k + j for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        if hit:
            want[i] = hit
    got: dict = {}
    for r in module.repeated_spans(table(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want and len(want) > 10
    assert module.repeated_spans(table(spark, rows).limit(0)).count() == 0


def test_merging_runs():
    r = random.Random(2)
    runs = [sorted(bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(r.randrange(20))) for _ in range(7)]
    coded = [suffixes.front_coded(run) for run in runs]
    assert [suffixes.plain(*c) for c in coded] == runs
    order = list(suffixes.merge([(run, c[0]) for run, c in zip(runs, coded)]))
    merged = [runs[a][i] for a, i, _ in order]
    assert merged == sorted(sum(runs, [])) and all(n == suffixes.common_prefix(x, y) for x, y, (_, _, n) in zip(merged, merged[1:], order[1:]))


def test_decontamination(spark):
    item, short = words(50, 30), words(51, 8)
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(short)), (3, "too few words"), (None, None), (4, ""), (None, " ".join(words(52, 6))), (5, "solo!")], "item_id long, text string")
    rows = awkward() + [
        (100, "Start, " + ", ".join(x.upper() for x in item[5:18]) + "! End", "a", "en"),
        (101, " ".join(item[5:17]), "a", "en"),
        (102, "x" + " ".join(short), "a", "en"),
        (103, " ".join(words(9, 40) + short + short), "a", "en"),
        (104, " ".join(words(52, 6)), "a", "en"),
        (105, "too few words, solos, and SOLO", "a", "en"),
    ]
    docs = table(spark, rows)
    got = {(r.doc_id, r.item_id, r.hits) for r in decontaminate.occurrences(docs, bench).collect()}
    assert got == {(100, 1, 1), (103, 2, 2), (104, None, 1), (105, 3, 1), (105, 5, 1)}
    assert got == {(r.doc_id, r.item_id, r.hits) for r in decontaminate.occurrences(docs, bench, shard_bytes=100).collect()}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.decontaminated(docs, bench, least=1).count() == len(rows) - 4
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows) and decontaminate.occurrences(docs.limit(0), bench).count() == 0


def test_lines(spark):
    rows = awkward() + [(200, "a\nb\nc\nd\ne", "a", "en"), (201, "x\nb\nc\nd\ny\nb\nc\nd\ne", "a", "en"), (202, "b\nc", "a", "en"), (203, "\n\n\n\n\n", "a", "en"), (204, "a\nb\nc\nd\ne", "a", "en")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.deduplicated(table(spark, rows)).collect() if r.doc_id and r.doc_id >= 200}
    assert got[200] == ("a\nb\nc\nd\ne", 0) and got[201] == ("x\ny", 7) and got[202] == ("b\nc", 0) and got[203] == ("\n\n\n\n\n", 0) and got[204] == ("", 5)
    assert lines.deduplicated(table(spark, rows)).count() == len(rows) and lines.deduplicated(table(spark, rows).limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(i, f"http://e/{i}?a b\n", f"<html>{' '.join(words(i, 50, 30))}</html>") for i in range(60)]
    pages += [(100, None, "no url"), (101, "http://e/", None), (102, "http://e/", ""), (None, "http://e/é", "é😀\r\n\r\n"), (0, *pages[0][1:]), (103, "http://long/", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "f", 1) for p in pages], "page_id long, url string, html string, file string, offset int").repartition(3)
    index = warc.archived(df, file_bytes=5_000, date="2024-05-06T07:08:09Z")
    assert index.count() == len(pages) and index.select("file").distinct().count() > 5
    assert Counter((r.page_id, r.url, r.html) for r in warc.restored(index).collect()) == Counter(pages)
    assert index.select("page_id", "digest").exceptAll(warc.restored(index).select("page_id", "digest")).count() == 0
    ids = []
    for r in index.where("file is not null").select("file").distinct().collect():
        data = open(r.file.removeprefix("file:").replace("//", "/", 1), "rb").read()
        records = list(warc.unpacked(data))
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data[:4] == b"\x5d\x2a\x4d\x18"
        ids += [re.search(rb"WARC-Record-ID: (\S+)", x)[1] for x in records]
        assert all(re.search(rb"WARC-Date: 2024-05-06T07:08:09Z\r\n", x) for x in records)
    assert len(ids) == len(set(ids)) > len(pages)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_files_that_no_index_names_go(spark, tmp_path):
    folder = tmp_path / "archive"
    stray = folder / "files" / "0a" / "left-over.warc.zst"
    stray.parent.mkdir(parents=True)
    stray.write_bytes(b"of a lost attempt")
    index = warc.archived(spark.createDataFrame([(1, "http://e/", "<p>one</p>")], "page_id long, url string, html string"), f"file://{folder}")
    assert warc.restored(index).first().html == "<p>one</p>" and not stray.exists() and len(list(folder.glob("files/*/*.zst"))) == 1


def test_hash_tree(spark):
    docs = table(spark, awkward() + [(i, "t", "s", "en") for i in range(1000, 5000)])
    place = lambda tree: {r.doc_id: (r.region, r.rack, r.shard) for r in hashtree.sharded(docs, tree).where("doc_id >= 1000").collect()}
    before = place(hashtree.TREE)
    assert hashtree.sharded(docs).count() == docs.count() and hashtree.sharded(docs.limit(0)).count() == 0
    share = Counter(p[0] for p in before.values())
    assert all(abs(share[r] / 4000 - w / 10) < 0.04 for r, (w, _) in hashtree.TREE.items())
    weight, racks = hashtree.TREE["west"]
    after = place(hashtree.TREE | {"west": (weight, racks | {"r0": (9.0, racks["r0"][1])})})
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(a[0] == b[0] == "west" and b[1] == "r0" for a, b in moved)
    with pytest.raises(ValueError):
        hashtree.sharded(docs, {"r": (0.0, {})})


def test_nodes_of_one_name_draw_apart(spark):
    """Every path of a tree of repeated names gets its share; nulls and repeated rows have a place of their own."""
    leaf = {"a": (1.0, {}), "b": (1.0, {})}
    tree = {x: (1.0, {y: (1.0, leaf) for y in "ab"}) for x in "ab"}
    docs = table(spark, [(i, None, "s", "en") for i in range(4000)] + [(None, None, None, None)] * 3)
    got = hashtree.sharded(docs, tree).collect()
    share = Counter((r.region, r.rack, r.shard) for r in got if r.doc_id is not None)
    assert len(share) == 8 and all(abs(n - 500) < 120 for n in share.values())
    assert len({(r.region, r.rack, r.shard) for r in got if r.doc_id is None}) == 1

    def drawn(*names):
        return -math.log((int(hashlib.md5("\x1f".join(names).encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    for r in got:
        key, path, below = str(r.doc_id) if r.doc_id is not None else "null", [], tree
        while below:
            path.append(min(below, key=lambda n: drawn(*path, n, key) / below[n][0]))
            below = below[path[-1]][1]
        assert (r.region, r.rack, r.shard) == tuple(path)


def test_language(spark):
    tongue = {lg: [f"{lg}{random.Random(f'{lg}{i}').randrange(10**6)}" for i in range(80)] for lg in ("aa", "bb")}
    make = lambda lg, seed: " ".join(random.Random(seed).choices(tongue[lg], k=60))
    train = [(i, make(lg, i), "s", lg) for i, lg in enumerate(["aa", "bb"] * 30)]
    test = [(1000 + i, make(lg, 1000 + i), "s", lg) for i, lg in enumerate(["aa", "bb"] * 20)]
    found = langid.identified(table(spark, awkward() + test), fit_on=table(spark, train))
    rows = found.collect()
    assert len(rows) == len(awkward()) + 40 and all(r.language == r.lang for r in rows if r.doc_id and 1000 <= r.doc_id < 2000)
    assert all(r.language is None for r in rows if not r.text)
    kept = langid.accepted(table(spark, awkward() + test), fit_on=table(spark, train))
    assert {r.doc_id for r in kept.collect()} >= set(range(1000, 1040))
    assert langid.accepted(table(spark, awkward()), fit_on=table(spark, train).limit(0)).count() == 0
    assert langid.identified(table(spark, []), fit_on=table(spark, [])).count() == 0


def test_mixing(spark):
    rows = awkward() + [(1000 + i, "x" * (1 + i % 7), f"s{i % 3 * i % 2}", "en") for i in range(900)]
    docs = table(spark, rows)
    got = mixing.mixed(docs, {"s0": 1.0, "s1": 3.0}).collect()
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text)
    assert set(chars) == {"s0", "s1"} and abs(chars["s1"] / (3 * chars["s0"]) - 1) < 0.1
    again = mixing.mixed(docs.repartition(7), {"s0": 1.0, "s1": 3.0}).collect()
    assert Counter((r.doc_id, r.copy) for r in got) == Counter((r.doc_id, r.copy) for r in again)
    assert mixing.mixed(docs).columns.count("copy") == 1 and mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs, {}).count() == 0


def test_mixing_of_repeated_rows_and_ids_far_apart(spark):
    """By brute force: the order is by id, null first, and by text; ids are clustered, with one far off, and most rows
    are the same."""
    rows = [(7, "x" * 10, "a", "en")] * 500 + [(i, "y" * (1 + i % 5), "a", "en") for i in range(1000, 1200)] + [(2**60, "z", "a", "en"), (None, "null id", "a", "en"), (-5, None, "b", "en"), (6, "", None, "en"), (8, "of no source", None, "en")]
    random.Random(3).shuffle(rows)
    docs = table(spark, rows)
    got = Counter((r.doc_id, r.source, r.copy) for r in mixing.mixed(docs.repartition(9), {"a": 1.0}, epochs=0.37).collect())
    chars = sum(len(t or "") for _, t, _, _ in rows)
    e = round(mixing.ONE * 0.37 * chars / sum(len(t) for _, t, s, _ in rows if s == "a"))
    want, reach = Counter(), mixing.offset("a")
    for i, _, s, _ in sorted((r for r in rows if r[2] == "a"), key=lambda r: (r[0] is not None, r[0] or 0)):
        want.update((i, s, c + 1) for c in range((reach + e) // mixing.ONE - reach // mixing.ONE))
        reach += e
    assert got == want and 150 < got[7, "a", 1] < 260
    free = mixing.mixed(docs).collect()
    assert {r.source for r in free} == {"a", None} and mixing.mixed(docs, epochs=0.0).count() == 0


def test_host_rules(spark):
    good = lambda i: " ".join(words(i, 40)) + "."
    rows = awkward() + [(1000 + i, good(i), "clean", "en") for i in range(50)] + [(2000 + i, "$$$ ### %%%", "spam", "en") for i in range(49)] + [(3000, good(1), "spam", "en")]
    rows += [(4000 + i, good(i) if i % 2 else "", "mixed", "en") for i in range(40)]
    rows = [(i, t, f"https://www.{src.upper()}.example:8080/a?b" if src == "spam" else src, lg) for i, t, src, lg in rows]
    docs = table(spark, rows)
    found = {r.doc_id: r for r in hostrules.verdicts(docs).where("doc_id between 1000 and 5000").collect()}
    assert {found[i].host for i in (1000, 2000, 4000)} == {"clean", "spam.example", "mixed"}
    assert all(found[1000 + i].keep for i in range(50)) and not found[3000].keep and found[3000].verdict == "blocked"
    assert all(found[4000 + i].keep == bool(i % 2) for i in range(40))
    assert hostrules.verdicts(docs).count() == len(rows) and hostrules.verdicts(docs.limit(0)).count() == 0


def test_hosts_of_urls(spark):
    urls = {"HTTP://u:p@WWW.Example.com:80/x": "example.com", "https://a.b.c": "a.b.c", "https://e.org?q=//x": "e.org", "src7": "src7", "": "", "www.plain.org/x": "www.plain.org/x", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.h for r in df.select(hostrules.host_of(df.url).alias("h")).collect()] == list(urls.values())


def test_each_rule_fails_what_it_names(spark):
    good = " ".join(words(1, 40))
    bad = {
        "few_words": "one",
        "symbols": "a b $$ c d",
        "capitals": " ".join(["ABCDEF"] * 9 + ["other"]),
        "no_letters": " ".join(words(2, 30) + ["12"] * 10),
        "word_length": " ".join(f"a{'b' * 16}{i}" for i in range(25)),
        "long_words": "a " + "b" * 100,
        "same_words": " ".join(["all", "the", "same"] * 10),
        "same_lines": "one line\n" * 7 + "other line",
        "bullets": "\n".join(f"- point one two three {w}" for w in words(3, 10)),
        "ellipses": "\n".join(f"read one two three {w} ..." for w in words(4, 10)),
        "filler": good + " lorem ipsum dolor",
    }
    assert list(bad) == list(hostrules.rules())
    df = spark.createDataFrame([(k, t) for k, t in {**bad, "good": good, "null": None}.items()], "k string, text string")
    rows = df.select("k", *(c.alias(k) for k, c in hostrules.counts(df.text).items())).select("k", *(c.alias(k + "_") for k, c in hostrules.rules().items())).collect()
    failed = {r.k: {x[:-1] for x, v in r.asDict().items() if x != "k" and v} for r in rows}
    assert all(k in failed[k] for k in bad) and not failed["good"] and failed["null"] == {"few_words"}
    assert all(failed[k] == {k} for k in bad if k not in ("long_words",)), failed


def test_prior_leaves_chance_out(spark):
    """Hosts that all fail at one rate differ by chance alone, so the prior counts much; hosts that differ, little."""
    r = random.Random(4)

    def fitted(rates):
        rows = [(n := r.randrange(1, 30), sum(r.random() < p for _ in range(n))) for p in rates]
        df = spark.createDataFrame(rows, "host_docs long, host_failed long").agg(*hostrules._moments())
        return df.select(*hostrules._prior()).first()

    a, b = fitted([0.3] * 2000)
    assert a + b > 60 and abs(a / (a + b) - 0.3) < 0.03
    a, b = fitted([r.betavariate(2, 3) for _ in range(3000)])
    assert abs(a - 2) < 0.4 and abs(b - 3) < 0.6
    assert tuple(fitted([0.0] * 5)) == (0.0, hostrules.PRIOR)
