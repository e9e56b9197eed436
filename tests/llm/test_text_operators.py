"""Operators on texts against brute force, over the same awkward table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from reelscope.llm import decontaminate as D
from reelscope.llm.components import components
from reelscope.llm.line_dedup import line_dedup
from reelscope.llm.minhash_dedup import minhash_dedup
from reelscope.llm.substring_dedup import substring_dedup

from . import cases

BLANK = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(expected, got):
    assert sorted(expected, key=cases.sort_key) == sorted(got, key=cases.sort_key)


@pytest.mark.parametrize(("window", "seed"), [(12, 4), (6, 6), (1, 1)])
def test_substrings(spark, window, seed):
    rows = [(r[0], BLANK.findall(r[1] or "")) for r in cases.documents()]
    count = Counter(tuple(w[s : s + window]) for _, w in rows for s in range(len(w) - window + 1))
    expected = []
    for i, w in rows:
        gone = {j for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for j in range(s, s + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = substring_dedup(cases.table(spark), window, seed)
    same(expected, [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()])
    assert substring_dedup(cases.table(spark, []), window, seed).count() == 0


BENCH = [(1, "w1 w2"), (2, None), (3, "a a a a a a a a a"), (4, "..."), (5, "one"), (6, "one"), (None, "one")]


@pytest.mark.parametrize("few", [500_000, 0])
def test_decontamination(spark, few, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", few)
    docs = cases.documents()
    bench = [*BENCH, (7, " ".join(docs[0][1].split()[20:40])), (8, docs[30][1])]
    windows = defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall((text or "").translate(LOW))
        m = min(8, len(w))
        for s in range(len(w) - m + 1):
            if m and item is not None:
                windows[tuple(w[s : s + m])].add(str(item))
    sizes = {len(k) for k in windows}
    expected = []
    for r in docs:
        w, hit, items = ALNUM.findall((r[1] or "").translate(LOW)), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s : s + m])):
                    items |= found
                    hit |= set(range(s, s + m))
        expected.append((r[0], len(w), len(hit), tuple(sorted(items))))
    table = spark.createDataFrame(bench, "item_id long, text string")
    out = D.decontaminate(cases.table(spark), table).collect()
    same(expected, [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out])
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit for r in out)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.decontaminate(cases.table(spark), none).collect()} == {0}
    assert D.decontaminate(cases.table(spark, []), none).count() == 0


def test_lines(spark):
    rows = [(r[0], r[1]) for r in cases.documents()]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n]]  # equal rows count as one document
    seen, expected = set(), []
    # order: null ids first; rows that share an id are ordered by a hash, so keep them free of shared lines here
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        filled = [j for j, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(filled) - 1):
            run = tuple(lines[j].strip(" ") for j in filled[s : s + 2])
            if run in seen:
                gone |= set(filled[s : s + 2])
            seen.add(run)
        expected.append((i, None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone)))
    assert sum(r[3] for r in expected) > 10
    out = line_dedup(cases.table(spark, [(*r, "en", "s", 0) for r in rows]))
    same(expected, [(r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()])
    assert line_dedup(cases.table(spark, [])).count() == 0
    assert line_dedup(cases.table(spark)).count() == len(cases.documents())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = cases.documents()
    sets = []
    for r in rows:
        w = BLANK.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    # ids that repeat with other texts are judged by text: nodes are the distinct sets, named by their smallest id
    low = {}
    for r, s in zip(rows, sets, strict=True):
        if s and r[0] is not None:
            low[frozenset(s)] = min(low.get(frozenset(s), r[0]), r[0])
    root = {s: s for s in low}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in low:
        for b in low:
            n = len(a & b)
            if n and 100 * n >= 80 * len(a | b):
                x, y = sorted((find(a), find(b)), key=lambda s: low[s])
                root[y] = x
    expected = [(r[0], len(s), low[find(frozenset(s))] if s and r[0] is not None else r[0]) for r, s in zip(rows, sets, strict=True)]
    out = minhash_dedup(cases.table(spark), shingle=k).collect()
    same(expected, [(r.doc_id, r.n_shingles, r.component_id) for r in out])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    assert minhash_dedup(cases.table(spark, [])).count() == 0


def test_a_group_of_near_copies_is_one_component(spark):
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(base[:-i] + [f"z{i}x{j}" for j in range(i)] if i else base), "en", "s", 0) for i in range(0, 40)]
    out = minhash_dedup(cases.table(spark, rows), shingle=4).collect()
    sets = [{tuple(r[1].split()[j : j + 4]) for j in range(297)} for r in rows]
    linked = [i for i, s in enumerate(sets) if 100 * len(s & sets[0]) >= 80 * len(s | sets[0])]
    assert {r.component_id for r in out if r.doc_id in linked} == {0}


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 9), (5, 4), (7, 5), (8, 7), (8, 4), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24)]
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {1: 1, 2: 1, 3: 1, 9: 9, 4: 4, 5: 4, 7: 4, 8: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_around_a_shared_passage(spark):
    import random

    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(rng.randint(1, 30))]), "en", "s", 0) for i in range(90)]
    sets = [{tuple(r[1].split()[j : j + 4]) for j in range(len(r[1].split()) - 3)} for r in rows]
    low = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    low[a] = low[b] = min(low[a], low[b])
        if _ > 3:
            break
    assert 20 < len(set(low)) < 90
    out = minhash_dedup(cases.table(spark, rows), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(low))


def test_texts_that_share_a_doc_id_link_each_by_its_own_text(spark):
    import corpus_pipeline

    near = lambda tag, i: " ".join([f"{tag}{j}" for j in range(100)] + [f"e{tag}{i}"])
    # 50 has a near copy of 1 and one of 2, and a text whose only near copy comes later
    texts = [(1, near("a", 0)), (2, near("b", 0)), (50, near("a", 1)), (50, near("b", 1)), (50, near("c", 0)), (60, near("c", 1)), (70, near("b", 2))]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    out = minhash_dedup(cases.table(spark, rows), shingle=4).collect()
    same([(1, 1, True), (2, 2, True), (50, 1, False), (50, 2, False), (50, 50, True), (60, 50, False), (70, 2, False)], [(r.doc_id, r.component_id, r.kept) for r in out])
    left = corpus_pipeline.near_duplicates(spark, cases.table(spark, rows), "").collect()
    same([texts[0], texts[1], texts[4]], [(r.doc_id, r.text) for r in left])


def test_long_lines_repeat_by_themselves(spark):
    import corpus_pipeline

    long, short = " ".join(f"l{i}" for i in range(50)), " ".join(f"s{i}" for i in range(49))
    texts = [f"a\n{long}\nb\n{short}\nc", f"d\n  {long}\n\ne\n{short}", long, f"f\n{long}\ng\n{long} more", f"a\n{long}\nh"]
    expected = [texts[0], f"d\n\ne\n{short}", "", f"f\ng\n{long} more", "h"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out = line_dedup(cases.table(spark, rows), long=50)
    same(enumerate(expected), [(r.doc_id, r.text) for r in out.collect()])
    out = corpus_pipeline.lines(spark, cases.table(spark, rows), "").collect()
    same([(i, t) for i, t in enumerate(expected) if t], [(r.doc_id, r.text) for r in out])


@pytest.mark.parametrize("seed", [3, 11])
def test_a_bucket_that_draws_its_smallest_node_again(spark, seed):
    # one bucket of 1, 2 and 3; only 2 and 3 are near, and its second draw is 1 again
    w = [f"{seed}w{i}" for i in range(20)]
    texts = [w[:16] + [f"{seed}x{i}" for i in range(4)], w, w[:19] + [f"{seed}y"]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts, start=1)]
    out = minhash_dedup(cases.table(spark, rows), shingle=1, bands=1, rows=2).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 2}


def test_the_exact_way_finds_what_no_band_proposes(spark):
    # with one band of many rows hardly any near copy shares it; the prefix join starts from all sets
    w = [f"w{i}" for i in range(60)]
    texts = [w, [*w[:58], "x", "y"], [*w[:57], "p", "q", "r"], [f"z{i}" for i in range(60)], ["z0"], [f"z{i}" for i in range(55)]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)] + [(9, None, "en", "s", 0), (None, " ".join(w), "en", "s", 0)]
    out = minhash_dedup(cases.table(spark, rows), shingle=1, bands=1, rows=40, exact=True).collect()
    same([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 3), (9, 9), (None, None)], [(r.doc_id, r.component_id) for r in out])


def test_joins_that_deal_out_hot_keys(spark):
    from pyspark.sql import functions as F

    from reelscope.llm.shared import dealt_join

    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 7).when(F.col("id") < 2990, F.col("id")).alias("key"))
    ones = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("first % 2 = 0")
    for how in ("inner", "left"):
        got = sorted(map(tuple, dealt_join(rows, ones, ["key"], 3000, how=how).select("id", "first").collect()))
        assert got == sorted(map(tuple, rows.join(ones, "key", how).select("id", "first").collect()))


def test_scratch_tables_go(spark, tmp_path):
    import glob

    from reelscope.llm import shared

    where = shared.shared_dir(spark).removeprefix("file://")
    count = lambda: len(glob.glob(f"{where}/reelscope/*/probe-*"))
    since = shared.position()
    with shared.scratch(spark):
        shared.written(spark.range(3), "probe")
        assert count() == 1
    assert count() == 0
    shared.written(spark.range(3), "probe")
    assert shared.kept(spark.range(4), "probe", since).count() == 4 and count() == 1
    shared.release(spark, since)
    assert count() == 0 and shared.sweep(spark) == 0
