"""A small table of documents with the cases every operator must take: nulls, empty and long texts, copies, ties."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use for themselves.
CLASHES = ["part", "anchor", "n", "key", "node", "component", "score", "w", "g", "places", "lines", "first", "wanted", "residue", "_doc_id"]


def documents(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Élan", "ñu", "日本", "Straße"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = say(60)
    lines = [" ".join(say(9)) for _ in range(5)]
    texts = []
    for i in range(24):
        words = say(rng.randint(30, 120))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = shared[rng.randint(0, 10) :]
        text = " ".join(words)
        if i % 5 == 0:
            text = lines[0] + "\n" + lines[1] + "\n\n" + text + "\n" + "\n".join(lines[2:])
        texts.append(text)
    near = say(200)
    for i in range(6):  # near copies
        copy = list(near)
        for _ in range(i):
            copy[rng.randrange(200)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "one two", "one two", "one", "", "   \n\t ", None, " ".join(say(5000)), "a " * 300, "x\n\ny\nx\n\ny"]
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[1], None, None, None), (None, None, "en", "s", 0), (3, "another text of a known id, " + " ".join(shared), "en", "s", 1), rows[4]]
    return rows


def table(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def sort_key(row):
    return tuple((x is not None, str(x)) for x in row)
