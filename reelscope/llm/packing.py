"""Cost-balanced packing of token sequences.

A document of n tokens costs ``linear * n + quadratic * n * n``: what its tokens cost each, and what attention within it
costs. Full pieces of ``capacity`` tokens fill a sequence each. What remains of the documents is taken in descending
length, each into the sequence that costs least so far among those with room; if none has room the document is cut, and
its parts fill what is left of the cheapest sequences. A block has as many sequences as its tokens need, so at most
``capacity - 1`` places of a block stay empty.

A block is what one task reads, up to ``block_tokens`` tokens, packed in memory and sent on at once: documents are not
shuffled, memory is bounded, and a task that is run again packs the same rows of its input in the same way.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.shared import small_batches
from reelscope.llm.tokens import WordTokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece, for items with the given token counts."""
    pieces, rest = [], []
    sequence = 0
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((i, at, capacity, sequence, 0))
            at += capacity
            sequence += 1
        if n > at:
            rest.append((n - at, i, at))
    cost = lambda n: linear * n + quadratic * n * n
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = -(-sum(x[0] for x in rest) // capacity)
    heap = [(0.0, sequence + j, 0) for j in range(open_)]  # cost, sequence, tokens so far
    for n, i, at in rest:
        passed = []
        while heap and heap[0][2] + n > capacity:
            passed.append(heapq.heappop(heap))
        if heap:
            c, s, used = heapq.heappop(heap)
            pieces.append((i, at, n, s, used))
            if used + n < capacity:
                passed.append((c + cost(n), s, used + n))
        else:  # no sequence has room for all of it
            passed.reverse()
            while n:
                c, s, used = passed.pop()
                part = min(n, capacity - used)
                pieces.append((i, at, part, s, used))
                at, n = at + part, n - part
                if used + part < capacity:
                    passed.append((c + cost(part), s, used + part))
        for x in passed:
            heapq.heappush(heap, x)
    return pieces


def _pack(path: str, end_id: int, capacity: int, linear: float, quadratic: float, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens.of(path)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal first, held
            rows = assign([len(x) for x in ids], capacity, linear, quadratic)
            raw = [ids[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in rows]
            columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[i] for i in columns[:, 0]], pa.int64()), pa.array(columns[:, 1]), pa.array(columns[:, 2]), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    pa.array([len(ids[i]) for i in columns[:, 0]], pa.int64()), pa.array(columns[:, 3] + first), pa.array(columns[:, 4]), pa.array(raw, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            first += int(columns[:, 3].max(initial=-1)) + 1
            docs.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc, row in zip(names, encode.rows(batch.column(batch.schema.get_field_index("text"))), strict=True):
                docs.append(doc)
                ids.append(np.append(row, np.uint16(end_id)) if end_id < 65536 else np.append(row.astype(np.uint32), np.uint32(end_id)))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield packed()
        if docs:
            yield packed()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored. ``tokenizer`` is a tokenizers JSON file that every
    executor has. A document is its token ids, then ``end_id``. A row for each piece: doc_id, start and length (tokens),
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset, ids (those
    numbers). Each token lies in one piece; the pieces of a sequence fill it from 0 without gaps.

    A null, empty or blank text is its ``end_id`` alone. Rows that repeat a doc_id, or have none, are each a document.
    An empty table has no pieces.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, end_id, capacity, linear, quadratic, block_tokens), PIECES)
