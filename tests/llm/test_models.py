"""Packing, preferences, neighbours and the trained models: round trips, brute force, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from reelscope.llm import charmodel, language_id, quality, toxicity
from reelscope.llm.nn_descent import search
from reelscope.llm.packing import assign, pack
from reelscope.llm.preference import conversations, preference_format
from reelscope.llm.tokens import WordTokens

from . import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_tokens_are_those_of_whole_texts():
    texts = ["it's They'RE a'b 12,5 x—y z  q <|endoftext|> <|endoftext|>x a<|startoftext|>b", "ΣΑΣ ΑΣ. İstanbul ß ﬁ é ́x", "", None, "日本語 テスト😀", "a\x1cb \x85 c\x0bd", "don't !!'s 's"]
    got = [list(map(int, x)) for x in WordTokens.of(PATH).rows(pa.array(texts))]
    assert got == reference_ids(texts)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_assignment_fills_sequences(capacity):
    rng = random.Random(capacity)
    lengths = [rng.choice([0, 1, 3, 50, rng.randint(1, 5000)]) for _ in range(200)]
    pieces = assign(lengths, capacity)
    got = [set() for _ in lengths]
    fill = {}
    for i, start, n, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert n > 0 and offset == fill.get(sequence, 0)
        fill[sequence] = offset + n
        assert not got[i] & set(range(start, start + n))
        got[i] |= set(range(start, start + n))
    assert [len(x) for x in got] == lengths
    assert max(fill.values()) <= capacity
    assert len(fill) == math.ceil(sum(lengths) / capacity) or len(fill) <= sum(n // capacity for n in lengths) + math.ceil(sum(n % capacity for n in lengths) / capacity)


def test_cheap_sequences_come_first():
    pieces = assign([10, 9, 4, 3], 16)
    where = {i: s for i, _, _, s, _ in pieces}
    assert where[0] != where[1] == where[2] and where[3] == where[0]


def test_packing_round_trip(spark):
    rows = cases.documents()
    out = pack(cases.table(spark, rows), PATH, 64).collect()
    expected = sorted(((r[0] is not None, r[0] or 0), tuple([*ids, 1])) for r, ids in zip(rows, reference_ids([r[1] for r in rows]), strict=True))
    by_sequence: dict = {}
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in expected)
    for doc in {r[0] for r in rows}:
        mine = [r for r in out if r.doc_id == doc]
        want = [ids for (_, k), ids in expected if k == doc and doc is not None]
        if len(want) == 1:
            got = sum((list(np.frombuffer(r.ids, dtype="<u4")) for r in sorted(mine, key=lambda r: r.start)), [])
            assert tuple(map(int, got)) == want[0] and {r.doc_tokens for r in mine} == {len(want[0])}
    assert pack(cases.table(spark, []), PATH).count() == 0


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    u, a, b, c = turn("user", "hi"), turn("assistant", "yes <|im_end|>"), turn("assistant", None), turn(None, "end")
    pairs = [("p", [u, a, u], [u, b]), ("q", [u, a], [u, a]), ("r", None, [a]), ("s", [u], [u, a, c]), ("s", [u], [u, a, c]), ("t", [], [])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "pair_id string, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>")
    df = df.withColumns({c: F.lit("clash") for c in ("n_common", "prompt", "completion", "mask", "tie", "side", "x", "rest")})
    out = preference_format(df).collect()
    assert len(out) == 2 * len(pairs)
    by = {(r.pair_id, r.side): r for r in out}
    assert by["p", "chosen"].n_common == 1 and by["p", "chosen"].prompt == by["p", "rejected"].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert [by["p", "chosen"].completion[m.first : m.past] for m in by["p", "chosen"]["mask"]] == ["yes <| im_end|><|im_end|>"]
    assert by["q", "chosen"].tie and by["q", "chosen"].completion == "" and by["q", "chosen"].n_common == 2
    assert by["r", "rejected"].prompt == "" and by["s", "chosen"].completion == "" and by["t", "chosen"].tie
    rows = spark.createDataFrame([(1, 1, "b", "y"), (1, 0, None, None), (1, 1, "a", "z"), (None, 1, "a", "q"), (2, None, "a", "q")], "conv_id long, turn long, role string, text string")
    got = conversations(rows).collect()
    assert [(r.conv_id, [(t.role, t.text) for t in r.turns]) for r in got] == [(1, [("unknown", ""), ("a", "z"), ("b", "y")])]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[50:80] = v[50]  # copies
    v[80:120] = v[80] + rng.normal(size=(40, 16)) * 0.01
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)]
    short = rng.normal(size=(30, 3)).astype(np.float32)
    other = [(2000 + i, [float(x) for x in short[i]]) for i in range(30)] + [(2030, [float(x) for x in short[0]])]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, []), (None, [1.0] * 16)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*rows, *bad, *other, rows[7]], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in cases.CLASHES})
    out = search(df, df.where("vec_id % 20 = 0")).toPandas()
    apart = out[out["query_id"] >= 2000].sort_values(["query_id", "rank"])  # vectors of three numbers are searched among their kind
    for q, g in apart.groupby("query_id"):
        d = np.sqrt(((short.astype(float) - short[q - 2000].astype(float)) ** 2).sum(axis=1))
        want = sorted([(x, 2000 + i) for i, x in enumerate(d) if 2000 + i != q] + [(d[0], 2030)])[:10]
        assert list(g["vec_id"]) == [i for _, i in want] and np.allclose(g["score"], [x for x, _ in want])
    assert set(apart["query_id"]) == {2000, 2020}
    out = out[out["query_id"] < 2000]
    hits = []
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g["score"], d[g["vec_id"]]) and (np.diff(g["score"]) >= 0).all()
        hits.append(len(set(order) & set(g["vec_id"])) / 10)
    assert len(hits) == 20 and np.mean(hits) >= 0.95
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert search(few, few.where("vec_id = 0")).count() == 2
    assert search(df.where("vec_id = 1000"), df).count() == 0


def test_neighbours_within_a_dense_group(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 64))
    v[:2500] = v[0] + v[:2500] * 1e-5  # near copies
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    hits = []
    for q, g in search(df, df.where("vec_id % 100 = 7 and vec_id < 2500")).toPandas().groupby("query_id"):
        d = ((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        hits.append(len(set(np.argsort(d, kind="stable")[:10]) & set(g["vec_id"])) / 10)
    assert len(hits) == 25 and np.mean(hits) >= 0.9


def texts(n, seed, alphabet, bad=()):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(60)) + (" " + rng.choice(bad) + " " + rng.choice(bad) if bad else "") for _ in range(n)]


def test_kneser_ney_sums_to_one():
    buf = np.frombuffer(b"the cat sat on the mat and the dog sat too ", dtype=np.uint8)
    code, _ = charmodel.codes(buf, np.array([0, len(buf)]), 3)
    keys, n = np.unique(code, return_counts=True)
    for modified in (False, True):
        m = charmodel.kneser_ney(["x"], keys, np.zeros(len(keys), dtype=int), n, 3, modified)
        for context in (int(keys[0]) >> 6, 63 << 6 | 5):
            every = np.arange(64, dtype=np.uint32) | np.uint32(context << 6)
            assert np.exp(m.logp(every)).sum() == pytest.approx(1, abs=1e-4)


def test_languages(spark):
    from pyspark.sql import functions as F

    rows = []
    for k, (lang, alphabet) in enumerate((("xx", "abcde"), ("yy", "vwxyzé"), ("zz", "klmnopß"))):
        rows += [(k * 100 + i, t, lang) for i, t in enumerate(texts(60, k, alphabet))]
    rows += [(905, "vé", None), (906, "k", None), (900, None, "xx"), (901, "", None), (902, "123 — €", "yy"), (903, "日本", None), (904, "q" * 50, None), (None, rows[0][1], None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("entropy", F.lit(1))
    known = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 900) & F.col("lang").isNotNull()
    apart = known & (F.col("doc_id") % 3 == 1)
    out = language_id.predict(df, language_id.fit(df.where(known & ~apart)), apart).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[r[0]].lang_pred == r[2] for r in rows if r[0] is not None and r[0] < 900)
    assert all(0 <= r.score <= 1 for r in out)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred != "und"
    assert by[904].rejected and sum(by[r[0]].rejected for r in rows if r[0] is not None and r[0] < 900) <= 8
    assert (by[905].lang_pred, by[906].lang_pred) == ("yy", "zz")  # shorter than an n-gram of the highest order
    empty = df.where("false")
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(empty), F.lit(False)).collect()} == {"und"}


def plain_kneser_ney(texts, order):
    """The model by definition: a function from a list of symbols before, and one symbol, to a probability."""
    def symbols(text):
        found = []
        for b in text.encode() + b" ":
            x = int(charmodel.SYMBOL[b])
            if not (x == 0 and found and found[-1] == 0):
                found.append(x)
        return found

    top = Counter()
    for text in texts:
        s = [0] * (order - 1) + symbols(text)
        top.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    tables = {order: top}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(k[1:] for k in tables[n + 1])

    def p(before, x, n=order):
        if n == 0:
            return 1 / 64
        before = tuple(before[len(before) - n + 1 :]) if n > 1 else ()
        t = tables[n]
        c = Counter(t.values())
        d = min(max(c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5, 0.05), 0.95)
        after = {k[-1]: v for k, v in t.items() if k[:-1] == before}
        lower = p(before, x, n - 1)
        if not after:
            return lower
        return (max(after[x] - d, 0) if x in after else 0) / sum(after.values()) + d * len(after) / sum(after.values()) * lower

    def entropy(text):
        s = [0] * (order - 1) + symbols(text)
        each = [-math.log(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s))]
        return sum(each) / len(each), len(each)

    return entropy


def test_languages_equal_the_models_by_definition(spark):
    from pyspark.sql import functions as F

    learned = {lang: texts(3, k, alphabet) for k, (lang, alphabet) in enumerate((("xx", "abcde"), ("yy", "bcdefé"), ("zz", "aefgß日")))}
    rows = [(None, t, lang) for lang, some in learned.items() for t in some]
    asked = ["a", "cab", " Bé dé\n\n", "ßäh! 日 aa", "zq", "bcd efe " * 20, learned["yy"][0], "cafe bad egg"]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict(df.where("doc_id is not null"), language_id.fit(df), F.lit(False)).collect()}
    models = {lang: plain_kneser_ney(some, language_id.ORDER) for lang, some in learned.items()}
    for i, text in enumerate(asked):
        every = {lang: m(text)[0] for lang, m in models.items()}
        best = min(sorted(every), key=every.get)
        assert out[i].lang_pred == best and out[i].entropy == pytest.approx(every[best], rel=1e-4) and out[i].n_symbols == models[best](text)[1]
        assert out[i].score == pytest.approx(1 / sum(math.exp((every[best] - e) * min(out[i].n_symbols, language_id.EVIDENCE)) for e in every.values()), rel=1e-3) and not out[i].rejected


def test_quality_equals_the_model_in_memory(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "en") for i, t in enumerate(texts(40, 1, "abcdefg"))] + [(100, None, "en"), (101, "", None), (102, "zzqq zzqq " * 30, "en"), (103, "ab", "fr"), (None, "abc abc", "en"), (104, "x" * 100_000, "fr")]
    rows += [(5, "another text of five", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in cases.CLASHES})
    apart = {r.text for r in df.where(F.pmod(F.xxhash64("text"), F.lit(quality.APART)) == 0).select("text").collect()}
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(7,), (None,), (555,)], "doc_id long")
    found = quality.quality(df, trusted).collect()
    assert len(found) == len(rows)
    out = {(r.doc_id, r.n_grams): r for r in found}
    learned = [r[1] for r in rows if (r[0] in range(30)) and r[1] not in apart]
    assert 0 < len(apart & {r[1] for r in rows[:30]}) < 15
    buf, offsets = quality.H.texts(pa.array(learned))
    s, at = quality._symbols(buf, offsets)
    keys, n = np.unique(quality._grams(s, at)[0], return_counts=True)
    m = charmodel.kneser_ney(["x"], keys, np.zeros(len(keys), dtype=int), n, quality.ORDER, modified=True)
    for r in rows:
        s, at = quality._symbols(*quality.H.texts(pa.array([r[1]], pa.string())))
        code, _ = quality._grams(s, at)
        got = out[r[0], len(code)].perplexity
        if not len(code):
            assert got is None and out[r[0], 0].keep
        else:
            assert got == pytest.approx(float(np.exp(-m.logp(code).mean())), rel=1e-3)
    by = {r.doc_id: r for r in found}
    assert not by[102].keep and by[104].threshold is None and by[104].keep
    one = np.quantile([r.perplexity for r in found if r.doc_id in range(30) and rows[r.doc_id][1] in apart], 0.95)
    assert by[1].threshold == pytest.approx(one, rel=0.2)
    assert quality.quality(df.where("false"), trusted).count() == 0


def test_quality_streams_the_pieces_and_answers_of_blocks(monkeypatch):
    rng = random.Random(8)
    wide = ["".join(rng.choices("abcdef ", k=rng.randint(50_000, 150_000))) for _ in range(25)]
    rows = [(i, t, rng.choice(["en", None]), i % 3 == 0) for i, t in enumerate([*wide, None, "", "ab", "x" * 300_000, *texts(40, 2, "abcdefg"), "y" * 1_500_000])] + [(None, "no id here", "en", False)]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "text", "lang", "apart"])
    sizes = sorted(len(zstandard.decompress(x)) for batch in quality._gather(iter([whole])) for x in batch.column("symbols").to_pylist() if x)
    assert len(sizes) > 2 and sizes[-2] <= 1 << 20  # no row has more than a piece, but for the longest text alone
    own = {}
    for i, (_, text, _, _) in enumerate(rows):
        s, at = quality._symbols(*quality.H.texts(pa.array([text], pa.string())))
        own[i] = (quality._grams(s, at)[0], len(s))

    def answer(code):
        return -(code % 97 + 1.0) / 20

    one = {}
    for block, distinct in ((quality.BLOCK, quality.DISTINCT), (1 << 20, quality.DISTINCT), (quality.BLOCK, 1 << 13)):
        monkeypatch.setattr(quality, "BLOCK", block)
        monkeypatch.setattr(quality, "DISTINCT", distinct)
        out = [r for batch in quality._gather(quality.H.blocks(whole, most=2 << 20)) for r in batch.to_pylist()]
        pieces, asks = ([r for r in out if (r["symbols"] is None) == x] for x in (False, True))
        assert max(sum(d["size"] for d in r["docs"]) for r in pieces) <= 1_500_001  # the longest text alone
        assert all(sum(d["size"] for d in r["docs"]) <= 1 << 20 or len(r["docs"]) == 1 for r in pieces)
        assert all(len(r["codes"]) <= quality.ROW for r in asks)
        assert len({r["block"] for r in pieces}) > 1 or (block, distinct) == (32 << 20, 1 << 20)
        stream, at = [], 0
        for b in sorted({r["block"] for r in out}):
            mine = [r for r in pieces if r["block"] == b]
            past = at + sum(len(r["docs"]) for r in mine)
            held = set(np.concatenate([own[i][0] for i in range(at, past)]).tolist())
            at = past
            codes = [c for r in asks if r["block"] == b for c in r["codes"]]
            assert sorted(held) == codes and [r["n"] for r in mine] == list(range(len(mine)))
            rng.shuffle(codes)
            stream += [(b, -1, c, answer(c), None, None) for c in codes] + [(b, r["n"], 0, 0.0, r["docs"], r["symbols"]) for r in mine]
        assert at == len(rows)
        docs = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("apart", pa.bool_()), ("size", pa.int64())]))
        columns = [pa.array(c, k) for c, k in zip(zip(*stream, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64(), docs, pa.binary()), strict=True)]
        sent = pa.RecordBatch.from_arrays(columns, names=["block", "n", "code", "logp", "docs", "symbols"])
        size = 4999
        got = [r for x in quality._read_off(sent.slice(a, size) for a in range(0, len(stream), size)) for r in x.to_pylist()]
        assert [(r["doc_id"], r["lang"], r["apart"]) for r in got] == [(i, lang, apart) for i, _, lang, apart in rows]
        for i, r in enumerate(got):
            code = own[i][0].astype(np.int64)
            assert r["n_grams"] == len(code)
            assert r["perplexity"] == (pytest.approx(float(np.exp(-answer(code).mean()))) if len(code) else None)
        one.setdefault("rows", got)
        assert [r["n_grams"] for r in got] == [r["n_grams"] for r in one["rows"]]


def test_toxicity(spark):
    bad = ["idiot", "moron", "scumbag"]
    clean, toxic = texts(200, 5, "abcdefghi"), texts(60, 5, "abcdefghi", bad)
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    labels = [(i, int(i >= 200)) for i in range(260) if i % 3] + [(5, None), (7, 0), (9999, 1)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, " ".join(clean[:30]) + " idiots moronic " + clean[2]), (None, clean[0]), rows[0]], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [i for i in range(260) if i % 3 == 0]
    good, evil = (np.array([out[i] for i in held if (i >= 200) == side]) for side in (False, True))
    assert (evil[:, None] > good[None, :]).mean() >= 0.97  # few labels: the order is right, the curve is cautious
    assert out[900] == out[901] == 0 and out[902] > np.quantile(good, 0.9)
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score(df, none).collect()) < 0.01
    assert toxicity.score(df.where("false"), model).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    clean = texts(40, 9, "abcdefghijklm")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts(30, 10, "abcdefghijklm", ["idiot", "moron"]))]
    copy = clean[0].rsplit(" ", 1)[0] + " other"
    rows += [(200, copy, "en", "s", 1), (201, clean[1] + " " + "alpha beta gamma delta epsilon zeta eta theta iota", "en", "s", 1), (202, None, None, None, None), (203, "top\n" + clean[3] + "\nx y z\nq r s", "en", "s", 1), (204, "x y z\nq r s\n" + texts(1, 77, "mnopq")[0], "en", "s", 1)]
    d = str(tmp_path)
    cases.table(spark, rows, clash=False).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i in range(40)] + [(100 + i, 1) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not [i for i in kept["toxicity"] if 100 <= i < 130] and set(range(40)) <= set(kept["toxicity"])
    assert kept["line_dedup"][204] == rows[-1][1].split("\n", 2)[2]
    assert 200 not in kept["minhash_dedup"] and set(range(40)) <= set(kept["minhash_dedup"])
    assert set(kept["decontamination"]) == set(kept["minhash_dedup"]) - {201}
    out = P.run(spark, d).toPandas()
    assert set(out["doc_id"]) == set(kept["decontamination"])
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def plain_features(text):
    """Subwords of each word, the slow way: the word itself and its runs of 3 to 6 bytes, marked at its ends by one space, but for all of it with both marks."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in text.encode())
    out = []
    for word in raw.split():
        marked = b" " + word + b" "
        out.append((word, [(k, marked[i : i + k]) for k in (3, 4, 5, 6) for i in range(len(marked) - k + 1) if k < len(marked)]))
    return out


def plain_bucket(kind, run):
    x = int.from_bytes(run, "little")
    return ((x * 8 + kind) * int(toxicity._MUL) % 2**64) >> (64 - toxicity.BITS)


def test_toxicity_scores_equal_those_by_definition():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.25, 1.5, -0.5)
    texts = ["", "a", "One Two-three, çedilla ñ", "word " * 40, " ".join(f"w{i}" for i in range(100)), "x" * 3000 + " tail", "\n\t ", "tie tie tie tie " * 12, "ends alike", "alike, alike begins", "one " * 30 + " ".join(f"v{i} v{i}" for i in range(40)), "a b a b " * 20]
    z, place = model.largest(*toxicity.H.texts(pa.array(texts)))
    for text, got, at in zip(texts, z, place, strict=True):
        words = plain_features(text)
        if not words:
            assert got == -np.inf and model.probability(np.array([got]))[0] == 0
            continue
        _, _, h = toxicity.H.words(*(lambda b: (b, toxicity._SEP, toxicity.H.LOWER))(toxicity.H.texts(pa.array([text]))[0]))
        read = [i for i in range(len(words)) if i < 2 or not words[i][0] == words[i - 1][0] == words[i - 2][0]]  # two in a row at most
        words, h = [words[i] for i in read], h[read]
        margins = [[float(model.margin[int(x) >> (64 - toxicity.BITS)])] + [float(model.margin[plain_bucket(k - 2, run)]) for k, run in runs] for (_, runs), x in zip(words, h, strict=True)]
        starts = range(0, max(1, -(-(len(words) - toxicity.PASSAGE) // (toxicity.PASSAGE // 2)) * (toxicity.PASSAGE // 2) + 1), toxicity.PASSAGE // 2)
        means = [(np.mean(sum(margins[s : s + toxicity.PASSAGE], [])), s) for s in starts]
        best = max(m for m, _ in means)
        assert got == pytest.approx(best + model.bias, abs=1e-5)
        assert means[[s for _, s in means].index(read.index(at))][0] == pytest.approx(best, abs=1e-5)
        found = toxicity.bags(text)
        assert found.margins(model.margin) == pytest.approx([m for m, _ in means], abs=1e-5)


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    vectors, weights, bias = rng.normal(size=(12, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    passages, labels, each = [np.array([0, 3, 3, 5]), np.array([1, 2]), np.array([3])], np.array([1, 0, 1]), np.array([0.7, 1.3, 0.5])
    _, index, by_place, grad_w, grad_b = toxicity.loss(vectors, weights, bias, passages, labels, each)
    grad_v = np.zeros_like(vectors)
    np.add.at(grad_v, index, by_place)
    for x, grad in ((vectors, grad_v), (weights, grad_w), (bias, grad_b)):
        for i in np.ndindex(x.shape):
            old, side = x[i], []
            for step in (1e-6, -1e-6):
                x[i] = old + step
                side.append(toxicity.loss(vectors, weights, bias, passages, labels, each)[0])
            x[i] = old
            assert (side[0] - side[1]) / 2e-6 == pytest.approx(grad[i], abs=1e-6)


def test_toxicity_samples_after_the_join(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(2, "another of two"), (7, None), (8, "long " * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(2, 1)], "doc_id long, toxic int")
    seen = {r.text: r.toxic for r in toxicity.sample(docs, labels, most=10).collect()}
    assert seen == {"text 0": 0, "text 1": 1, "another of two": 1, "text 3": 1, "text 4": 0, "text 5": 1, "long " * 40_000: 0}
