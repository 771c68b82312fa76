"""Packing documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.encode import encoded


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: split items into ``windows`` groups with near-equal sums; returns item positions.

    Every item begins as a partition with one filled window. The two partitions with the largest
    spread are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, np.array([i]), np.array([windows - 1])))
    heapq.heapify(heap)
    place = np.empty(windows, np.int64)
    while len(heap) > 1:
        _, i, a, items, slots = heapq.heappop(heap)
        _, _, b, others, places = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        place[order] = np.arange(windows)
        sums = sums[order]
        slots = place[np.concatenate([slots, windows - 1 - places])]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), i, sums, np.concatenate([items, others]), slots))
    found: list[list[int]] = [[] for _ in range(windows)]
    if heap:
        for item, slot in zip(heap[0][3].tolist(), heap[0][4].tolist()):
            found[slot].append(item)
    return found


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the bound of the total on, in which differencing stays within capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        count += 1


#: Tokens of the longest piece that shares a window, and pieces that are differenced together.
PIECE, GROUP = 512, 512


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 1, text: str = "text", piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """Encode every whole text, end it with ``end`` and place all ids into sequences of ``capacity``.

    Full sequences are cut off a document's front first. What remains is cut into pieces of at most
    ``piece`` tokens, and ``group`` pieces at a time are split by Karmarkar-Karp differencing into
    the fewest windows that hold them. Documents are packed where they are read: nothing is
    shuffled, a task holds one group, and a lost task makes the same sequences again. Each task
    ends with one smaller group.

    Rows: doc_id, start (ids of the document before the piece), length, ids (binary, uint32), doc_tokens,
    sequence_id (unique, not dense), offset (place in the sequence, gapless from 0). A null text is
    empty: one piece with the end id. Repeated doc_ids and null doc_ids are documents of their own.
    No documents: no rows. Other columns are not read.
    """
    kind = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        out: list[tuple] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, waiting, out
            while len(waiting) >= group or (last and waiting):
                now, waiting = waiting[:group], waiting[group:]
                for window in windows([x[2] for x in now], capacity):
                    offset = 0
                    for i in sorted(window):
                        out.append((*now[i], sequence, offset))
                        offset += now[i][2]
                    sequence += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names)
                out = []

        for batch in batches:
            for step, ids, starts in encoded(batch, vocabulary, "text", end):
                ids = ids.astype("<u4")
                for key, a, b in zip(step.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    at, n = 0, b - a
                    while n - at >= capacity:
                        out.append((key, at, capacity, ids[a + at : a + at + capacity].tobytes(), n, sequence, 0))
                        sequence += 1
                        at += capacity
                    while at < n:
                        size = min(piece, n - at)
                        waiting.append((key, at, size, ids[a + at : a + at + size].tobytes(), n))
                        at += size
                yield from flush(False)
        yield from flush(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, kind)
