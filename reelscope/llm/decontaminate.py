"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every window of ``window`` item words is caught: of each window's ``gram``-word hashes the smallest is a fingerprint, in
items and documents alike, so both sides of an equal window hold the same fingerprint at the same place in it. The
fingerprints are joined, the words beside each joined gram are compared outwards, and a match that reaches ``window``
words marks all of its words. An item shorter than the window, but not empty, is a single window of its own length.

Documents are never shuffled with their texts while the item fingerprints are few (``BROADCAST_ROWS``, counted first);
beyond that only (document, place, hash) rows are joined by shuffle, and the texts of the documents found are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.shared import let, part_of, written

#: Item fingerprints are broadcast up to this many rows, about 200 bytes each.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower case: ASCII but for digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """Lower-cased words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), GAP), ""), F.array().cast("array<string>"))


def _places(grams: Column, span: int) -> Column:
    """Places of the grams that are smallest in any ``span`` consecutive ones, ties included."""
    if span == 1:
        return F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>"))
    lows = F.transform(F.sequence(F.lit(0), F.size(grams) - span), lambda s: F.least(*[F.get(grams, s + j) for j in range(span)]))

    def chosen(m: Column) -> Column:
        def smallest(p: Column) -> Column:
            found = F.lit(False)
            for j in range(span):
                found = found | (F.get(grams, p) == F.get(m, p - j))
            return F.coalesce(found, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(grams) - 1), smallest)

    return F.when(F.size(grams) >= span, let(lows, chosen)).otherwise(F.array().cast("array<int>"))


def _prints(w: Column, kinds: list[tuple[int, int]]) -> Column:
    """(want, k, p, h) of each fingerprint: for windows of ``want`` words, the hash and place of a ``k``-word gram."""
    none = F.array().cast("array<bigint>")

    def of(hashes: Column) -> Column:
        found = []
        for want, k in kinds:
            grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))  # noqa: B023
            one = lambda g, p: F.struct(F.lit(want).alias("want"), F.lit(k).alias("k"), p.alias("p"), F.get(g, p).alias("h"))  # noqa: E731, B023
            found.append(let(F.when(F.size(hashes) >= k, grams).otherwise(none), lambda g: F.transform(_places(g, want - k + 1), lambda p: one(g, p))))  # noqa: B023
        return F.concat(*found)

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def _beside() -> list[Column]:
    """The gram at ``p`` and up to ``want - k`` words to its left (nearest first) and right."""
    w, p, k, reach = F.col("w"), F.col("p"), F.col("k"), F.col("want") - F.col("k")
    left = F.least(p, reach)
    return [F.slice(w, p + 1, k).alias("gram"), F.reverse(F.slice(w, p - left + 1, left)).alias("left"), F.slice(w, p + k + 1, reach).alias("right")]


def _alike(a: str, b: str, most: int) -> Column:
    """How many leading elements of two arrays agree."""
    n = F.lit(0)
    for j in reversed(range(most)):
        n = F.when(F.get(F.col(a), F.lit(j)) == F.get(F.col(b), F.lit(j)), 1 + n).otherwise(0)
    return n


def _hits(docs: DataFrame, items: DataFrame, window: int, gram: int, kinds: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, part, first, past, context) for each match that fills a window, and (context, item_id).

    An item has windows of one kind, by its own length; a document is read once for all kinds.
    """
    marks = items.withColumn("w", words()).select("item_id", "w", F.explode(_prints(F.col("w"), kinds)).alias("x")).select("item_id", "w", "x.*")
    marks = marks.where(F.col("want") == F.least(F.size("w"), F.lit(window))).select("item_id", "want", "h", *_beside())
    marks = written(marks.groupBy("want", "h", "gram", "left", "right").agg(F.collect_set("item_id").alias("items")).withColumn("context", F.monotonically_increasing_id()), "marks")
    few = marks.count() <= BROADCAST_ROWS
    sides = marks.select("h", F.col("want").alias("its_want"), F.col("gram").alias("its_gram"), F.col("left").alias("its_left"), F.col("right").alias("its_right"), "context")
    found = docs.withColumn("w", words()).drop("text")
    if few:
        sides = F.broadcast(sides)
        found = found.withColumn("prints", _prints(F.col("w"), kinds))
    else:
        rows = found.select("doc_id", "part", F.explode(_prints(F.col("w"), kinds)).alias("x")).select("doc_id", "part", "x.*")
        rows = rows.join(marks.select("h").distinct(), "h").groupBy("doc_id", "part").agg(F.collect_set(F.struct("want", "k", "p", "h")).alias("prints"))
        rows = written(rows, "places").withColumnsRenamed({"doc_id": "_doc", "part": "_part"})
        found = found.join(rows, F.expr("doc_id <=> _doc and part = _part"))
    at = found.select("doc_id", "part", "w", F.explode("prints").alias("x")).select("doc_id", "part", "w", "x.*")
    its = ["its_want", "its_gram", "its_left", "its_right", "context"]
    if few:
        at = at.join(sides, "h").select("doc_id", "part", "want", "k", "p", *_beside(), *its)
    else:
        at = at.select("doc_id", "part", "want", "k", "p", "h", *_beside()).join(sides, "h")
    at = at.where((F.col("want") == F.col("its_want")) & (F.col("gram") == F.col("its_gram")))
    at = at.withColumn("l", _alike("left", "its_left", window - gram)).withColumn("r", _alike("right", "its_right", window - gram))
    at = at.where(F.col("l") + F.col("r") + F.col("k") >= F.col("want"))
    return at.select("doc_id", "part", (F.col("p") - F.col("l")).alias("first"), (F.col("p") + F.col("k") + F.col("r")).alias("past"), "context"), marks.select("context", F.explode("items").alias("item_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, gram: int = 5) -> DataFrame:
    """Words of each document that lie in a window of ``window`` consecutive words of a benchmark item.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. One row for each input
    row: doc_id, part (128 bits of the text), n_words, n_hit (words hit), n_items (items with windows found), items (their ids as sorted strings),
    spans (merged, first and last word). Benchmark rows without item_id cannot be named and are no items. A null text has no words and no hit; null ids stay null; items that repeat
    each other are all listed; rows that share a doc_id but not a text are judged apart; either table may be empty.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of("text").alias("part"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull())
    sized = items.withColumn("n", F.size(words())).where("n > 0")
    # At most window - 1 values come to the driver: the lengths of items shorter than a window.
    short = sorted(r.n for r in sized.where(F.col("n") < window).select("n").distinct().collect())
    keys = ["doc_id", "part"]
    hits, of = _hits(docs, sized.select("item_id", "text"), window, gram, [(window, gram), *((m, m) for m in short)])
    hits = written(hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("first", "past"))).alias("runs"), F.collect_set("context").alias("contexts")), "hits")
    named = hits.select(*keys, F.explode("contexts").alias("context")).join(of, "context").select(*keys, F.col("item_id").cast("string").alias("item_id"))
    named = named.groupBy(*keys).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = hits.select(F.col("doc_id").alias("_d"), F.col("part").alias("_p"), "runs").join(named, F.expr("doc_id <=> _d and part = _p")).drop(*keys)
    base = docs.select(*keys, F.size(words()).cast("long").alias("n_words"))
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<first: int, past: int>>"),
        lambda done, r: F.when((F.size(done) > 0) & (F.element_at(done, -1)["past"] >= r["first"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["past"], r["past"]).alias("past")))),
        ).otherwise(F.concat(done, F.array(F.struct(r["first"].alias("first"), r["past"].alias("past"))))),
    )
    out = base.join(out.select("_d", "_p", merged.alias("runs"), "items"), F.expr("doc_id <=> _d and part = _p"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "part", "n_words",
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["past"] - r["first"])), F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.coalesce(F.transform("runs", lambda r: F.struct(r["first"].cast("long").alias("first"), (r["past"] - 1).cast("long").alias("last"))), F.array().cast("array<struct<first: bigint, last: bigint>>")).alias("spans"),
    )
