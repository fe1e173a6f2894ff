"""Packing of token ids into sequences by the sum-of-squares rule.

Every task packs the documents it reads, online and in order. A document is cut at whole
sequences; what is left of it goes into the fill level that makes the sum of squared counts of
partially filled sequences least: with ``n[h]`` sequences filled to ``h``, size ``s`` goes to the
``h`` (0: a new sequence) for which that sum grows least; full and empty sequences don't count.
The level array holds 1,023 counts, whatever the number of documents.

Left at the end of a task, open sequences are closed in order of fill: pieces of the emptiest are
cut to fill the fullest. Where the last one is no power of two long, it is cut into sequences that
are, so nothing is padded. A task keeps open sequences only; their number is bounded by ``OPEN``,
beyond which the emptiest are closed early in the same way.

``sequence_id`` is unique over all tasks (task number, then order) and the same when a task is run
again on the same rows.

Defined results: a null text is empty and holds the end id alone. A null ``doc_id`` stays null;
repeated rows are packed one by one. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import by_bytes, documents, read
from .registry import query

LENGTH, OPEN = 1024, 4096

Piece = tuple[object, int, np.ndarray, int]  # document, start in it, ids, its number in the task


class Packer:
    """Sum-of-squares placement; ``done`` holds the sequences that are closed."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.counts = np.zeros(length + 1, dtype=np.int64)  # entries 0 and ``length`` stay 0
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.done: list[list[Piece]] = []

    def _pop(self, level: int) -> list[Piece]:
        sequence = self.open[level].pop()
        self.counts[level] -= 1
        self.n_open -= 1
        return sequence

    def _push(self, level: int, sequence: list[Piece]) -> None:
        self.open.setdefault(level, []).append(sequence)
        self.counts[level] += 1
        self.n_open += 1

    def place(self, piece: Piece) -> None:
        size = len(piece[2])
        if size == self.length:
            self.done.append([piece])
            return
        levels = self.length - size + 1  # 0 .. length - size
        rise = 2 * (self.counts[size:] - self.counts[:levels]) + 2  # growth of the sum of squares
        rise[0] -= 1  # a new sequence leaves no level
        rise[-1] -= 1  # a full one enters none
        rise[1:][self.counts[1:levels] == 0] = np.iinfo(np.int64).max
        # of equal levels the fullest, which leaves the least room
        level = levels - 1 - int(np.argmin(rise[::-1]))
        sequence = self._pop(level) if level else []
        sequence.append(piece)
        if level + size == self.length:
            self.done.append(sequence)
        else:
            self._push(level + size, sequence)
        if self.n_open > self.most_open:
            self.close(self.most_open // 2)

    def close(self, leave: int = 0) -> None:
        """Closes open sequences, the emptiest first, until ``leave`` are left."""
        while self.n_open > max(leave, 1):
            high = max(k for k, v in self.open.items() if v)
            full = self._pop(high)
            low = min(k for k, v in self.open.items() if v)
            spare = self._pop(low)
            room = self.length - high
            left = low
            while room and spare:
                doc, start, ids, number = spare.pop()
                take = min(room, len(ids))
                full.append((doc, start, ids[:take], number))
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], number))
                room -= take
                left -= take
            if room:
                self._push(self.length - room, full)
            else:
                self.done.append(full)
            if left:
                self._push(left, spare)
        if not leave and self.n_open:
            self._split(self._pop(max(k for k, v in self.open.items() if v)))

    def _split(self, sequence: list[Piece]) -> None:
        """Cuts the last sequence into lengths that are powers of two."""
        total, rest = sum(len(x[2]) for x in sequence), sequence[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            part: list[Piece] = []
            while room:
                doc, start, ids, number = rest.pop()
                take = min(room, len(ids))
                part.append((doc, start, ids[:take], number))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], number))
                room -= take
            self.done.append(part)


def packed(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, if asked for, its ``ids``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = tokens.encoder(path), Packer(length)
        first = TaskContext.get().partitionId() << 40
        sizes: dict[int, int] = {}  # tokens of the documents with pieces that are still open
        made = documents_seen = 0

        def rows(batch_docs: dict[int, int]) -> pa.RecordBatch:
            nonlocal made
            out: list[list] = [[] for _ in NAMES]
            for sequence in packer.done:
                offset = 0
                for doc, start, ids, number in sequence:
                    values = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sizes[number], first + made, offset, ids.astype(np.int64) if with_ids else None)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    offset += len(ids)
                made += 1
            packer.done.clear()
            held = {x[3] for found in packer.open.values() for s in found for x in s}
            for number in [k for k in sizes if k not in held and k not in batch_docs]:
                del sizes[number]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, TYPES, strict=True)], NAMES)

        for batch in by_bytes(batches, "text"):
            ids_of = batch.column("doc_id").to_pylist()
            start, rest, current = 0, np.zeros(0, np.uint32), -1

            def whole(doc: object, ids: np.ndarray, number: int, last: bool) -> np.ndarray:
                """Places the full lengths of ``ids``, at the document's end the rest too; gives what is left."""
                nonlocal start
                while len(ids) >= length or last and len(ids):
                    packer.place((doc, start, ids[:length].copy(), number))
                    start += min(length, len(ids))
                    ids = ids[length:]
                return ids

            waiting: list[tuple[object, list[np.ndarray], int]] = []
            for i, part in tokens.ids(enc, batch.column("text").to_pylist()):
                if i != current:
                    current = i
                    waiting.append((ids_of[i], [], documents_seen))
                    documents_seen += 1
                waiting[-1][1].append(part)
            for doc, parts, number in waiting:
                start = 0
                parts.append(np.array([end_id], np.uint32))
                sizes[number] = sum(map(len, parts))
                rest = np.zeros(0, np.uint32)
                for k, part in enumerate(parts):
                    rest = whole(doc, np.concatenate([rest, part]) if len(rest) else part, number, k + 1 == len(parts))
            yield rows({})
        packer.close()
        yield rows({})

    return documents(docs).mapInArrow(pack, ", ".join(f"{n} {t}" for n, t in zip(NAMES, SQL_TYPES, strict=True))).select(NAMES if with_ids else NAMES[:-1])


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
TYPES = [pa.int64()] * 7 + [pa.list_(pa.int64())]
SQL_TYPES = ["long"] * 7 + ["array<long>"]


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
