"""Token ids of whole texts, by a ``tokenizers`` file that drops white space, with each distinct word encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from reelscope.llm import hashing as H

#: Distinct words that a worker remembers, about 25 bytes each; beyond that the memory starts anew.
REMEMBERED = 2_000_000


class WordTokens:
    """Encodes texts word by word.

    A tokenizer that drops white space and never merges across it gives a text the ids of its words, one after the
    other. So texts are parted at ASCII white space, and each word is encoded when first seen and found again by its
    64-bit hash. The tokenizer must have no special token that holds a space, and no rule that looks beyond one.
    """

    _known: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The encoder for a file, kept by the worker process from task to task."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kind = np.uint16 if self._tokenizer.get_vocab_size() <= 65536 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(0, dtype=np.uint64)  # sorted; the next two go with it
        self._start = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int32)
        self._ids = np.zeros(1 << 16, dtype=self._kind)
        self._used = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [x.ids for x in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total = int(size.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + total] = np.fromiter((i for x in ids for i in x), dtype=self._kind, count=total)
        at = np.searchsorted(self._hash, hashes)
        self._hash = np.insert(self._hash, at, hashes)
        self._start = np.insert(self._start, at, self._used + np.cumsum(size) - size)
        self._size = np.insert(self._size, at, size)
        self._used += total

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column; a null has none."""
        for batch in H.blocks(pa.RecordBatch.from_arrays([column], names=["text"])):
            buf, offsets = H.texts(batch.column(0))
            start, end, h = H.words(buf, H.BLANK)
            row = H.by_row(start, offsets)
            if len(self._hash) > REMEMBERED:
                self._forget()
            distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
            at = np.searchsorted(self._hash, distinct)
            new = np.ones(len(distinct), dtype=bool)
            if len(self._hash):
                new = self._hash[np.minimum(at, len(self._hash) - 1)] != distinct
            if new.any():
                raw = buf.tobytes()
                f = first[new]
                self._learn(distinct[new], [raw[a:b].decode("utf-8") for a, b in zip(start[f].tolist(), end[f].tolist(), strict=True)])
                at = np.searchsorted(self._hash, distinct)
            at = at[which]
            size = self._size[at]
            upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            ids = self._ids[np.repeat(self._start[at] - upto[:-1], size) + np.arange(upto[-1])]
            for a, b in zip(upto[row[:-1]].tolist(), upto[row[1:]].tolist(), strict=True):
                yield ids[a:b]
