"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its partition as they come. A document fills
whole windows with its leading tokens; what remains (less than a window) goes
to the fill level that minimises the sum of squared counts of partly filled
windows, read from an array of counts by level. Windows that are still open
at the end pour into one another (a piece may be cut anywhere), so that each
partition pads one window at most. No row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm._common import _arrow_schema, pick, slices, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROW = 1 << 20
#: Fixed value: what splits a text before the merges of this kind of vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    ``ranks`` may name a file with the same vocabulary as ranks. A second
    library then encodes texts of Latin-1 characters, whose classes all versions
    of Unicode share, about three times as fast and to the same ids; the
    tokenizer itself encodes all others, and those that spell a special token.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast and self._plain(text) else self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


class Packer:
    """Places pieces (document, start, length) into windows of ``size`` tokens."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def add(self, piece: tuple) -> list[tuple] | None:
        """Place a piece shorter than a window; returns the window that it filled."""
        n = piece[2]
        level = np.arange(0, self.size - n + 1)
        gain = 2 * self.count[level + n] + 1 - (2 * self.count[level] - 1) * (level > 0)
        gain[-1] = 1 - 2 * self.count[self.size - n]  # a full window leaves the sum
        gain[(self.count[level] == 0) & (level > 0)] = _ROW * _ROW
        best = int(len(gain) - 1 - np.argmin(gain[::-1]))  # ties: the fullest level
        if best:
            self.count[best] -= 1
            window = self.open[best].pop()
        else:
            window = []
        window.append(piece)
        if best + n == self.size:
            return window
        self.count[best + n] += 1
        self.open[best + n].append(window)
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """Pour the open windows together, the fullest first, cutting pieces at the borders."""
        windows = [w for level in reversed(self.open) for w in level]
        tail: list[tuple] = []
        low, held = len(windows) - 1, 0
        for i, window in enumerate(windows):
            if i > low:
                break
            fill_ = sum(p[2] for p in window)
            while fill_ < self.size and (tail or low > i):
                if not tail:
                    tail = windows[low]
                    low -= 1
                doc, start, n, *more = tail.pop()
                take = min(n, self.size - fill_)
                window.append((doc, start, take, *more))
                fill_ += take
                if take < n:
                    tail.append((doc, start + take, n - take, *more))
            yield window
        if tail:
            yield tail


def pack_documents(df: DataFrame, model_path: str, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and pack into windows of ``size`` ids.

    Returns a row for each piece: doc_id, start (ids of the document before
    it), length, ids_crc32, doc_tokens (with the end id), sequence_id (unique;
    partition and running number) and offset (gapless from 0). Every id lies in
    exactly one piece. A null or empty text has the end id alone; other columns
    are ignored; repeated rows are packed each; an empty table gives no piece.
    A task holds the ids of documents in open windows only, as check sums need
    whole pieces. ``ranks_path`` may name the same vocabulary as ranks.
    """
    arrow = _arrow_schema(df.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = ByteBpe(model_path, ranks_path), Packer(size)
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        columns: list[list] = [[] for _ in arrow]

        def emit(window: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, n, total, origin, ids in window:
                crc = zlib.crc32(memoryview(ids)[4 * (start - origin) : 4 * (start - origin + n)])
                for column, v in zip(columns, (doc, start, n, crc, total, base + made, at), strict=True):
                    column.append(v)
                at += n
            made += 1

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if len(columns[0]) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                for c in columns:
                    c.clear()

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, t in zip(part.column(0).to_pylist(), texts(part), strict=True):
                    ids = model.encode(t) + end
                    total = len(ids) // 4
                    whole = total - total % size
                    for start in range(0, whole, size):
                        emit([(doc, start, size, total, 0, ids)])
                    if whole < total and (full := packer.add((doc, whole, total - whole, total, whole, ids[4 * whole :]))):
                        emit(full)
                yield from ready(20_000)
        for window in packer.rest():
            emit(window)
        yield from ready(1)

    return pick(df, doc_id=doc_id, text=text).mapInArrow(run, SCHEMA)
