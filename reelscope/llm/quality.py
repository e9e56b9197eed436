"""Text quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts runs of ``ORDER`` symbols (see ``charmodel``) of all trusted documents, and stays in Spark, sharded by
n-gram: counts, continuation counts of the lower orders and sums for each context are tables. Documents are gathered, as
they are read, into blocks of some MB, kept as pieces of compressed symbols. A block asks for each distinct n-gram it
holds, once; the requests are joined with the model's shards, order by order, and the answers go back to the block, which
then reads off the perplexity of each of its documents. So what is shuffled is distinct n-grams of large blocks, not
those of texts. No row holds a whole block: its answers, then its pieces stream through the task that reads them off,
which keeps the answers of one block and one piece.

Thresholds are quantiles of perplexity over trusted documents of each language that the model has not learned from: one
in ``APART`` of them, by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm import charmodel as M
from reelscope.llm import hashing as H
from reelscope.llm.shared import small_batches, written

ORDER = 5
#: A block ends once it has so many bytes of symbols, or so many distinct n-grams; only a single longer text has far more.
BLOCK, DISTINCT = 32 << 20, 1 << 20
#: n-grams in a row of requests, at most.
ROW = 1 << 14
#: Trusted ids are thinned out beforehand by a hash of so many values: the set that is broadcast has no more.
RESIDUES = 1 << 20
#: One in so many trusted texts is kept out of the model and sets the thresholds.
APART = 10
_SYMBOL = M.SYMBOL.astype(np.uint8)


def _symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without repeated gaps, each text followed by one gap at least, and where each text begins."""
    s = _SYMBOL[buf]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != M.GAP) | (s[:-1] != M.GAP)
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return s[keep], upto[offsets]


def _grams(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each n-gram within one text, index of its text)."""
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    x = s[:n].astype(np.uint32)
    for j in range(1, ORDER):
        x = x << np.uint32(M.WIDTH) | s[j : j + n]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    one = row[:n] == row[ORDER - 1 :]
    return x[one], row[:n][one]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the compressed symbols of its text."""
    packer = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in H.blocks(whole):
            s, at = _symbols(*H.texts(batch.column(1)))
            packed = [packer.compress(s[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "symbols"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams over all the texts of a task."""
    opener = zstandard.ZstdDecompressor()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts = [np.frombuffer(opener.decompress(x), dtype=np.uint8) for x in batch.column(0).to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        code, _ = _grams(np.concatenate(parts) if parts else np.zeros(0, np.uint8), at)
        held.append(np.unique(code, return_counts=True))
        if len(held) == 16:
            held = [M.counted(held)]
    if held:
        keys, n = M.counted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["code", "n"])


BLOCKS = "block long, n int, docs array<struct<doc_id: bigint, lang: string, apart: boolean, size: bigint>>, symbols binary, codes array<int>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, numbered within the task: pieces of some documents with all their symbols, compressed, and at the
    end of a block its distinct n-grams."""
    packer = zstandard.ZstdCompressor(level=3)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("apart", pa.bool_()), ("size", pa.int64())]))
    block = n = held = waiting = 0
    known, some = np.zeros(0, dtype=np.uint32), []

    def row(docs: pa.Array, symbols: bytes | None, codes: pa.Array) -> pa.RecordBatch:
        columns = [pa.array([block], pa.int64()), pa.array([n], pa.int32()), docs, pa.array([symbols], pa.binary()), codes]
        return pa.RecordBatch.from_arrays(columns, names=["block", "n", "docs", "symbols", "codes"])

    def asked() -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate([known, *some])).astype(np.int32)
        for a in range(0, len(every), ROW):
            part = pa.array(every[a : a + ROW])
            yield row(pa.nulls(1, kind), None, pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part))

    for whole in batches:
        for batch in H.blocks(whole):
            s, at = _symbols(*H.texts(batch.column(1)))
            docs = pa.StructArray.from_arrays([*(batch.column(c) for c in (0, 2, 3)), pa.array(np.diff(at))], fields=list(kind.value_type))
            yield row(pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), packer.compress(s.tobytes()), pa.nulls(1, pa.list_(pa.int32())))
            some.append(np.unique(_grams(s, at)[0]))
            waiting += len(some[-1])
            if waiting > max(len(known), DISTINCT >> 2):
                known, some, waiting = np.unique(np.concatenate([known, *some])), [], 0
            n += 1
            held += len(s)
            if held >= BLOCK or len(known) >= DISTINCT:
                yield from asked()
                block, n, held, waiting = block + 1, 0, 0, 0
                known, some = np.zeros(0, dtype=np.uint32), []
    if n:
        yield from asked()


def _read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Perplexities from rows in the order of blocks, a block's answers (``n`` is -1) before its pieces."""
    opener = zstandard.ZstdDecompressor()
    block = None
    some: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        blocks, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(n < 0) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if blocks[a] != block:
                block, some = blocks[a], []
                keys, logp = np.zeros(0, dtype=np.uint32), np.zeros(0)
            if n[a] < 0:
                some.append((batch.column(2).slice(a, b - a).to_numpy().astype(np.uint32), batch.column(3).slice(a, b - a).to_numpy().copy()))
                continue
            if some:
                keys, logp = (np.concatenate(x) for x in zip(*some, strict=True))
                order = np.argsort(keys)
                keys, logp, some = keys[order], logp[order], []
            for i in range(a, b):
                docs = batch.column(4)[i].values
                s = np.frombuffer(opener.decompress(batch.column(5)[i].as_buffer()), dtype=np.uint8)
                code, row = _grams(s, np.concatenate([[0], np.cumsum(docs.field(3).to_numpy())]))
                count = np.bincount(row, minlength=len(docs))
                total = np.bincount(row, weights=logp[np.searchsorted(keys, code)], minlength=len(docs))
                perplexity = np.exp(-total / np.maximum(count, 1))
                yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in range(3)), pa.array(perplexity, mask=count == 0), pa.array(count)], names=["doc_id", "lang", "apart", "perplexity", "n_grams"])


def _model(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(code, logp) for each of the distinct n-grams ``asked``, by joins with the counts, from the lowest order up."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy(F.col("code").bitwiseAND((1 << M.WIDTH * n) - 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        table = tables[n] = written(tables[n], f"counts{n}")
        c = [r or 0 for r in table.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()]
        y = min(max(c[0] / (c[0] + 2 * c[1]) if c[0] + 2 * c[1] else 0.5, 0.05), 0.95)
        d = [min(max(i + 1 - (i + 2) * y * c[i + 1] / max(c[i], 1), 0.05), i + 0.95) for i in range(3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        contexts = table.groupBy(F.shiftright("code", M.WIDTH).alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("taken"))
        want = asked.select(F.col("code").bitwiseAND((1 << M.WIDTH * n) - 1).alias("code")).distinct()
        rows = want.join(table.select("code", "n", discount.alias("less")), "code", "left").withColumn("context", F.shiftright("code", M.WIDTH)).join(contexts, "context", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / (1 << M.WIDTH)))
        else:
            rows = rows.withColumn("tail", F.col("code").bitwiseAND((1 << M.WIDTH * (n - 1)) - 1)).join(below.select(F.col("code").alias("tail"), F.col("p").alias("lower")), "tail")
        own = F.coalesce((F.col("n") - F.col("less")) / F.col("total"), F.lit(0.0))
        weight = F.coalesce(F.col("taken") / F.col("total"), F.lit(1.0))
        below = written(rows.select("code", (own + weight * F.col("lower")).alias("p")), f"order{n}")
    return below.select("code", F.ln("p").alias("logp"))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.95) -> DataFrame:
    """doc_id, lang, perplexity, n_grams, threshold, keep; one row for each row of ``docs`` (doc_id, text, lang).

    ``trusted`` has the doc_ids of the text to learn from; a tenth of their texts, by hash, sets the thresholds instead.
    A document is kept up to the ``quantile`` of perplexity of those of its language; a language without any has no
    threshold, and keeps all. Texts too short for one n-gram, and null ones, have null perplexity and are kept. Null
    languages form a group. Every row is scored by its own text, whether its doc_id is null, repeated or neither; rows
    that share a trusted doc_id are all trusted. Without trusted text every n-gram is equally likely.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    apart = F.coalesce(F.pmod(F.xxhash64(text), F.lit(APART)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"), apart.alias("apart"))
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    residue = F.pmod(F.xxhash64("doc_id"), F.lit(RESIDUES)).alias("residue")
    near = rows.where("not apart").withColumn("residue", residue).join(F.broadcast(ids.select(residue).distinct()), "residue", "left_semi").select("doc_id", "text")
    mine = near.mapInArrow(_small, "doc_id long, symbols binary").join(ids, "doc_id", "left_semi").select("symbols")
    counts = written(mine.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "counts")
    # The blocks of all tasks get numbers of their own.
    block = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("block")
    blocks = written(rows.mapInArrow(_gather, BLOCKS).withColumn("block", block), "blocks")
    asked = blocks.where("codes is not null").select("block", F.explode(F.col("codes").cast("array<bigint>")).alias("code"))
    logp = _model(counts, written(asked.select("code").distinct(), "asked"))
    pieces = blocks.where("symbols is not null").select("block", "n", F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("logp"), "docs", "symbols")
    answers = asked.join(logp, "code").select("block", F.lit(-1).alias("n"), "code", "logp", *(F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in ("docs", "symbols")))
    stream = answers.unionByName(pieces).repartition("block").sortWithinPartitions("block", "n")
    scored = stream.mapInArrow(_read_off, "doc_id long, lang string, apart boolean, perplexity double, n_grams long")
    out = written(scored, "perplexity")
    limits = out.where("apart and perplexity is not null").join(ids, "doc_id", "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold")).withColumnRenamed("lang", "_lang")
    out = out.join(limits, F.expr("lang <=> _lang"), "left")
    return out.select("doc_id", "lang", "perplexity", "n_grams", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
