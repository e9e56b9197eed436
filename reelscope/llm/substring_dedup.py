"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each ``window`` consecutive words, the first smallest of the hashes of its ``seed``-word
grams. A repeated window has the same anchor wherever it stands, so a window can only repeat within a group of equal
anchors. Each anchor *owns* the windows it is the minimum of; they form one run, and everything the owned windows span
is the anchor's context, the furthest that a match through this anchor can be extended to both sides.

1. Count each anchor, and whether its contexts differ. An anchor that stands alone is dropped.
2. Where all contexts of an anchor are equal, every owned window repeats: the match extends to both ends.
3. Where contexts differ (the edges of passages, edited copies), the owned windows are hashed one by one and counted by
   (anchor, window), 128 bits in all.
4. Overlapping windows merge into maximal repeats; covered words go.

Nothing is paired within a group: groups are only counted, with partial sums before each shuffle, and the counts are
joined back many-to-one, so a hot passage costs one row for each place it stands, and those rows are dealt out over tasks
(``dealt_join``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm import hashing as H
from reelscope.llm.shared import dealt_join, part_of, small_batches, written

ANCHORS = "doc_id long, part binary, anchor long, context long, first int, last int"
WINDOWS = "doc_id long, part binary, anchor long, content long, first int"


def _owned(batch: pa.RecordBatch, window: int, seed: int):
    """Per block: word table, first word of each row, and each anchor with its owned run of windows.

    Rows of less than ``window`` words have no window. Positions count words within the block.
    """
    buf, offsets = H.texts(batch.column(batch.schema.get_field_index("text")))
    start, end, h = H.words(buf, H.BLANK)
    row = H.by_row(start, offsets)
    grams = H.ngrams(h, seed)
    at = H.minimum(grams, window - seed + 1)  # the anchor of each window of the block
    of = np.searchsorted(row, np.arange(len(at)), side="right") - 1
    fits = np.arange(len(at)) + window <= row[of + 1]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    firsts = np.flatnonzero(new & fits)
    keys = np.flatnonzero(fits)
    # A run ends before the next run's first window or where the row's windows end.
    upto = np.searchsorted(keys, np.append(firsts[1:], len(at)))
    lasts = keys[upto - 1] if len(firsts) else firsts
    return buf, offsets, start, end, h, row, grams, at, of, firsts, lasts


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.blocks(whole):
                _, _, _, _, h, row, grams, at, of, a, b = _owned(batch, window, seed)
                doc, part = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part"))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(pa.array(of[a])), part.take(pa.array(of[a])), pa.array(grams[at[a]].view(np.int64)),
                        pa.array((H.spans(h, a, b + window, 7) ^ H.mix((at[a] - a).astype(np.uint64))).view(np.int64)),
                        pa.array((a - row[of[a]]).astype(np.int32)), pa.array((b - row[of[a]]).astype(np.int32)),
                    ],
                    names=["doc_id", "part", "anchor", "context", "first", "last"],
                )

    return run


def _windows(window: int, seed: int):
    """Hashes of the windows owned by the anchors whose first windows the column ``wanted`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.blocks(whole):
                _, _, _, _, h, row, grams, at, of, a, b = _owned(batch, window, seed)
                doc, part = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part"))
                wanted = batch.column(batch.schema.get_field_index("wanted"))
                flat, size = wanted.flatten().to_numpy(), np.diff(wanted.offsets.to_numpy())
                keep = np.isin(a, flat + np.repeat(row[:-1], size))
                a, b = a[keep], b[keep]
                n = b - a + 1
                s = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(pa.array(of[s])), part.take(pa.array(of[s])), pa.array(grams[at[s]].view(np.int64)),
                        pa.array(H.spans(h, s, s + window, 11).view(np.int64)), pa.array((s - row[of[s]]).astype(np.int32)),
                    ],
                    names=["doc_id", "part", "anchor", "content", "first"],
                )

    return run


def _cut(window: int):
    """Merge the repeated windows of each text and take out what they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.blocks(whole):
                buf, offsets = H.texts(batch.column(batch.schema.get_field_index("text")))
                raw = buf.tobytes()
                column = lambda c: batch.column(batch.schema.get_field_index(c))
                out = {k: [] for k in ("n_words", "n_removed", "kept_text", "spans")}
                first, last = column("firsts"), column("lasts")
                for i in range(batch.num_rows):
                    text = raw[offsets[i] : offsets[i + 1]]
                    words = text.split()  # at space and the controls 9 to 13
                    spans: list[list[int]] = []
                    if first[i].is_valid:
                        a, b = first.values[first.offsets[i].as_py() : first.offsets[i + 1].as_py()].to_numpy(), last.values[last.offsets[i].as_py() : last.offsets[i + 1].as_py()].to_numpy()
                        order = np.argsort(a, kind="stable")
                        for s, e in zip(a[order].tolist(), (b[order] + window).tolist(), strict=True):
                            if spans and s <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], e)
                            else:
                                spans.append([s, e])
                    kept, at = [], 0
                    for s, e in spans:
                        kept += words[at:s]
                        at = e
                    kept += words[at:]
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_text"].append(b" ".join(kept).decode("utf-8", "replace"))
                    out["spans"].append([{"first": s, "last": e - 1} for s, e in spans])
                yield pa.RecordBatch.from_arrays(
                    [
                        column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in out["kept_text"]], pa.string()),
                        pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
                )

    return run


def _sum(counted: DataFrame) -> int:
    return counted.agg(F.sum("n")).first()[0] or 0


def substring_dedup(docs: DataFrame, window: int = 35, seed: int = 8) -> DataFrame:
    """Remove every word inside a run of ``window`` words that also starts anywhere else, in any text or the same one.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns one row for each input row: doc_id,
    n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, spans (maximal repeats, in words).

    A null or empty text has no words: nothing removed, kept_text empty. A null doc_id comes back as null. Rows that
    repeat each other repeat all their windows and lose all of them; rows that share a doc_id but not a text are kept
    apart by a hash of the text. An empty table gives an empty result. Texts are read whole, of any length.
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must lie between 1 and window")
    small_batches(docs.sparkSession)
    # part tells apart rows that share a doc_id; equal rows have equal windows, so they can share their spans.
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of("text").alias("part"), F.col("text").cast("string").alias("text"))
    keys, on = ["doc_id", "part"], F.expr("doc_id <=> _doc_id and part = _part")
    beside = lambda right: right.withColumnsRenamed({k: f"_{k}" for k in keys}).hint("shuffle_hash")
    # Anchors are hashed twice, once to be counted and once to be found again: cheaper than to keep them all on disk.
    found = base.mapInArrow(_anchors(window, seed), ANCHORS)
    groups = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    groups = written(groups.where("n > 1").select("anchor", "n", (F.col("low") != F.col("high")).alias("differ")), "anchors")
    shared = dealt_join(found.drop("context"), groups, ["anchor"], _sum(groups), by=["doc_id", "first"])
    runs = F.collect_set(F.when(~F.col("differ"), F.struct("first", "last")))
    per_doc = shared.groupBy(*keys).agg(runs.alias("runs"), F.collect_set(F.when(F.col("differ"), F.col("first"))).alias("wanted"))
    texts = written(base.join(beside(per_doc), on, "left").select(*keys, "text", "runs", "wanted"), "texts")
    unsure = F.size("wanted") > 0
    singles = written(texts.where(unsure).select(*keys, "text", "wanted").mapInArrow(_windows(window, seed), WINDOWS), "windows")
    repeated = written(singles.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    edges = dealt_join(singles, repeated, ["anchor", "content"], _sum(repeated), by=["doc_id", "first"]).groupBy(*keys).agg(F.collect_set(F.struct("first", F.col("first").alias("last"))).alias("edges"))
    rest = texts.where(unsure).drop("wanted").join(beside(edges), on, "left").withColumn("runs", F.concat("runs", F.coalesce("edges", F.array().cast("array<struct<first: int, last: int>>"))))
    every = texts.where(~F.coalesce(unsure, F.lit(False))).select("doc_id", "text", "runs").unionByName(rest.select("doc_id", "text", "runs"))
    out = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<first: bigint, last: bigint>>"
    return every.select("doc_id", "text", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts")).mapInArrow(_cut(window), out)
