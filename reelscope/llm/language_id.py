"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counts are taken over every training text: each task sums its own n-grams, Spark sums those of all tasks by (language,
n-gram), and the counts of a language at a time are turned into a model of sorted hash arrays. A text gets the language of
the lowest cross-entropy for each symbol. It is *rejected*, besides, if that entropy lies above the ``calibration``
quantile of texts that were kept out of training and given the same language: it is then unlike all that was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm import charmodel as M
from reelscope.llm import hashing as H
from reelscope.llm.shared import small_batches, written

ORDER = 4
#: Symbols that count as independent evidence, at most, when entropies are turned into a score.
EVIDENCE = 100


def fit(docs: DataFrame, order: int = ORDER) -> list[M.KneserNey]:
    """A model of each language in ``docs`` (text, lang), by name; rows where either is null are left out.

    A language has at most 64 ** order distinct n-grams, whatever the corpus; real ones have some 10^5. The driver takes
    the counts of one language at a time and keeps its finished arrays, which grow with the distinct n-grams seen.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for batch in H.blocks(whole):
                code, row = M.codes(*H.texts(batch.column(0)), order)
                of = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], dtype=np.uint64)
                keys, n = np.unique(code.astype(np.uint64) | of[row] << np.uint64(32), return_counts=True)
                held.append((keys, n))
                if len(held) == 32:
                    held = [M.counted(held)]
        if held:
            keys, n = M.counted(held)
            languages = pa.array(list(names), pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([languages, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts = written(docs.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "counts")
    models = []
    for lang in sorted(r.lang for r in counts.select("lang").distinct().collect()):
        rows = counts.where(F.col("lang") == lang).select("code", "n").toArrow()
        code, n = (rows.column(c).to_numpy() for c in ("code", "n"))
        models.append(M.kneser_ney([lang], code.astype(np.uint32), np.zeros(len(code), dtype=np.int64), n, order))
    return models


def predict(docs: DataFrame, models: list[M.KneserNey], calibrating, calibration: float = 0.995) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats for each symbol), n_symbols, rejected; one row for each row.

    ``calibrating`` is a boolean Column over ``docs``: rows that no model has learned from, and whose entropies set the
    limit of rejection of the language they get; a language without any rejects nothing. Whole texts are read, from
    their first symbol on. A text that is null or has no letter is ``und``, with score 0 and null entropy; so is any, if
    no language was learned. ``score`` is the share of the best language when each of ``EVIDENCE`` symbols, or all if
    fewer, testifies; equal entropies go to the first language by name. Null and repeated doc_ids come back as they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    order = models[0].order if models else ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_models = shared.value
        names = pa.array([*(m.languages[0] for m in known_models), "und"], pa.string())
        for whole in batches:
            for batch in H.blocks(whole):
                buf, offsets = H.texts(batch.column(1))
                code, row = M.codes(buf, offsets, order)
                n = np.bincount(row, minlength=batch.num_rows)
                letters = M.SYMBOL[buf] != M.GAP
                has = np.add.reduceat(letters, offsets[:-1], dtype=np.int64) > 0
                plain = np.add.reduceat(letters & (buf < 128), offsets[:-1], dtype=np.int64) > 0
                for i in np.flatnonzero(has & ~plain):
                    has[i] = any(c.isalpha() for c in batch.column(1)[int(i)].as_py())
                known = has if known_models else np.zeros_like(has)
                total = np.zeros((batch.num_rows, max(1, len(known_models))))
                distinct, where = np.unique(code, return_inverse=True)  # each model is asked once for each n-gram
                for j, m in enumerate(known_models):
                    total[:, j] = np.bincount(row, weights=m.logp(distinct)[where, 0], minlength=batch.num_rows)
                entropy = -total / np.maximum(n, 1)[:, None]
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(len(best)), best]
                share = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), names.take(pa.array(np.where(known, best, len(names) - 1))), pa.array(np.where(known, share, 0.0)),
                        pa.array(low, mask=~known), pa.array(n.astype(np.int64)), batch.column(2),
                    ],
                    names=["doc_id", "lang_pred", "score", "entropy", "n_symbols", "calibrating"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(calibrating, F.lit(False)).alias("calibrating"))
    out = written(docs.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, n_symbols long, calibrating boolean"), "languages")
    limits = out.where("calibrating and entropy is not null").groupBy("lang_pred").agg(F.percentile_approx("entropy", calibration).alias("highest"))
    out = out.join(limits.hint("broadcast"), "lang_pred", "left")  # a row for each language
    return out.select("doc_id", "lang_pred", "score", "entropy", "n_symbols", F.coalesce(F.col("entropy") > F.col("highest"), F.lit(False)).alias("rejected"))
