"""Packing: best-fit decreasing over a segment tree indexed by remaining capacity.

A document's ids (its tokens, then one end id) are first cut into full windows;
each of these is a sequence by itself.  What is left over, shorter than a
window, is placed best-fit decreasing: the tree finds the open window with the
least remaining capacity that still holds the piece.

Each task packs its own documents in blocks of `block_tokens` ids, so there is
no shuffle, a task holds a bounded amount, and a retried task writes the same
sequences again.  A sequence's id is the task's partition number and a counter.

Defined cases: null text counts as empty (its end id only); repeated rows are
packed as often as they occur; an empty table gives no row; null ids are
carried along; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import doc_view, slices, byte_lengths

#: Fixed value: the byte-level pre-token pattern of the vocabulary, with possessive repeats (it never has to give back).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LONG_BLANK = re.compile(r"\s{5000}")


class ByteTokenizer:
    """Ids of a byte-level BPE file, as `tokenizers` gives them without special tokens added.

    The file's own vocabulary and merge order drive a second engine that is several
    times faster.  Texts that it can't treat alike (an added token's string inside
    the text, very long white space) go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        # byte-level files spell a byte that is no printable character as the next free one from U+0100
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        spelled = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(spelled[c] for c in token): i for token, i in ids.items() if token not in self.added}
        self.fast = tiktoken.Encoding("byte_level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(x in text for x in self.added) or (len(text) > 5000 and LONG_BLANK.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity of at least `need`."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest window that holds `need`."""
        count, i = self.count, need + self.size
        if not count[i]:
            while True:
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; windows are numbered from 0, ties go by position."""
    tree, out, windows = CapacityTree(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room, window = tree.take(n) or (capacity, windows)
        windows += window == windows
        out[i] = (window, capacity - room)
        if room > n:
            tree.add(room - n, window)
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 0, block_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    view = doc_view(docs, id_col, text_col)
    id_type = view.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        full: list[tuple] = []
        rest: list[tuple] = []
        full_tokens = rest_tokens = 0

        def rows(pieces: list[tuple], places: list[tuple[int, int]], windows: int):
            nonlocal first
            columns = list(zip(*pieces, strict=True))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], kind),
                    pa.array(columns[1], pa.int64()),
                    pa.array([len(x) // 4 for x in columns[2]], pa.int64()),
                    pa.array(columns[2], pa.binary()),
                    pa.array(columns[3], pa.int64()),
                    pa.array([first + w for w, _ in places], pa.int64()),
                    pa.array([o for _, o in places], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            first += windows
            return out

        def packed():
            places = best_fit_decreasing([len(x[2]) // 4 for x in rest], window)
            return rows(rest, places, 1 + max(w for w, _ in places))

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i, j in slices(byte_lengths(batch.column("text")), 1 << 20):
                part = batch.slice(i, j - i)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = tokenizer.encode((text or b"").decode("utf-8", "replace")) + end
                    n = len(ids) // 4
                    for s in range(0, n - n % window, window):
                        full.append((doc, s, ids[4 * s : 4 * (s + window)], n))
                        full_tokens += window
                    if n % window:
                        rest.append((doc, n - n % window, ids[4 * (n - n % window) :], n))
                        rest_tokens += n % window
                    if full_tokens >= block_tokens // 4:
                        yield rows(full, [(k, 0) for k in range(len(full))], len(full))
                        full, full_tokens = [], 0
                    if rest_tokens >= block_tokens:
                        yield packed()
                        rest, rest_tokens = [], 0
        if full:
            yield rows(full, [(k, 0) for k in range(len(full))], len(full))
        if rest:
            yield packed()

    return view.mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
