"""Benchmark decontamination: a broadcast hash set of the test items' word windows, looked up in every training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.shared import lone_steps, stored, strings, text_steps

#: Words of a window.
WIDTH = 10
#: Windows, and bytes of their words, that are sent to the executors at once; a larger benchmark goes in several rounds.
SENT_WINDOWS, SENT_BYTES = 500_000, 32_000_000
#: Bytes of text that one step holds as arrays; a longer text is cut into steps that overlap by a window.
STEP = 2_000_000
#: Bits of the table that most hashes are turned away by.
SIEVE_BITS = 20

#: Bytes of words: digits, small letters (capitals are lowered first) and all of a character beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_BASE = 0xBF58476D1CE4E5B9
_known: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse; a step's worth is kept."""
    if _known and n <= len(_known[0][0]):
        return _known[0][0][:n], _known[0][1][:n]
    many = max(n, 2 * STEP)
    made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(many - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    if many <= 2 * STEP:
        _known[:] = [made]
    return made[0][:n], made[1][:n]


@dataclass
class Words:
    """Words of several texts: where each begins and ends in ``data``, its hash, and each text's first word and end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def split(data: np.ndarray, edges: np.ndarray) -> Words:
    """Words of the texts that lie between the ``edges`` of ``data`` (bytes). No word reaches over an edge."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    before = np.concatenate([[False], inside])[: len(data)]
    starts = np.flatnonzero(inside & (~before | first[: len(data)]))
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    ends = np.flatnonzero(inside & (~after | first[1 : len(data) + 1])) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _BYTE * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= hashes >> np.uint64(29)
    return Words(data, starts, ends, hashes * _NEXT, np.searchsorted(starts, edges))


def windows(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending lengths the hash of the window of so many words that begins at each word."""
    value = np.zeros(len(hashes), np.uint64)
    for k in range(max(lengths, default=0)):
        if k >= len(hashes):
            return
        value = value[: len(hashes) - k] * _NEXT + hashes[k:]
        if k + 1 in lengths:
            mixed = value ^ (value >> np.uint64(31))
            yield k + 1, mixed * _BYTE


@dataclass
class Benchmark:
    """Distinct windows in order of their hashes, with their words, and the items (as numbers) that hold each."""

    hashes: np.ndarray
    lengths: np.ndarray
    words: pa.Array
    items: pa.Array
    names: list[str]

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.hashes >> np.uint64(64 - SIEVE_BITS)] = True
        self.kinds = sorted(set(self.lengths.tolist()))

    def found(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of every occurrence, its words compared."""
        at, which = [], []
        ends = np.repeat(text.offsets[1:], np.diff(text.offsets))  # the word behind each word's text
        for length, values in windows(text.hashes, self.kinds):
            some = np.flatnonzero(self.sieve[values >> np.uint64(64 - SIEVE_BITS)])
            some = some[some + length <= ends[some]]
            low = np.searchsorted(self.hashes, values[some], "left")
            high = np.searchsorted(self.hashes, values[some], "right")  # equal hashes of unlike words stand side by side
            for i, a, b in zip(some[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                own = b" ".join(text.data[s:e].tobytes() for s, e in zip(text.starts[i : i + length], text.ends[i : i + length]))
                for n in range(a, b):
                    if self.words[n].as_py() == own:
                        at.append(i)
                        which.append(n)
        return np.array(at, np.int64), np.array(which, np.int64)


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (hash, words, items): the distinct windows of all items; an item of fewer words is one window, one without words has none.

    ``items`` are ids as strings, ascending, without null: the windows of an item without id are looked for, but it has no name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, "text", STEP):
                words = split(*_bytes(step.column("text")))
                counts = np.diff(words.offsets)
                for length, values in windows(words.hashes, sorted({*np.minimum(counts, width)[counts > 0].tolist()})):
                    owner = np.repeat(np.arange(len(counts)), counts)[: len(values)]
                    fits = (np.arange(len(values)) + length <= words.offsets[1:][owner]) & (np.minimum(counts, width)[owner] == length)
                    at = np.flatnonzero(fits)
                    own = [b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[i : i + length], words.ends[i : i + length])) for i in at.tolist()]
                    items = step.column("item").take(pa.array(owner[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), pa.array([length] * len(at), pa.int32()), pa.array(own, pa.binary()), items], ["hash", "length", "words", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(run, "hash long, length int, words binary, item string")
    return found.groupBy("hash", "length", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the places between them."""
    plain = strings(texts)
    edges = np.frombuffer(plain.buffers()[1], np.int64, len(plain) + 1)
    data = np.frombuffer(plain.buffers()[2], np.uint8, edges[-1]) if len(plain) and edges[-1] else np.zeros(0, np.uint8)
    return data, edges


def _gathered(rows: list) -> Benchmark:
    names = sorted({x for r in rows for x in r["items"]})
    number = {x: n for n, x in enumerate(names)}
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    rows = [rows[n] for n in order.tolist()]
    items = pa.array([[number[x] for x in r["items"]] for r in rows], pa.list_(pa.int32()))
    return Benchmark(hashes[order], np.array([r["length"] for r in rows], np.int64), pa.array([bytes(r["words"]) for r in rows], pa.large_binary()), items, names)


def _long(data: np.ndarray, benchmark: Benchmark, step: int) -> tuple[int, list[tuple[np.ndarray, ...]]]:
    """Number of words and occurrences (first word, window, byte from, byte to) of one text, step by step.

    A step begins with the last words of the one before, one fewer than the longest window, so no occurrence is cut.
    """
    keep = max(benchmark.kinds, default=1) - 1
    start, words, size, out = 0, 0, step, []
    while True:
        end = min(start + size, len(data))
        while end < len(data) and _INSIDE[_LOWER[data[end]]]:  # to the end of the word
            end += int((~_INSIDE[_LOWER[data[end : end + 4096]]]).argmax()) or min(4096, len(data) - end)
        part = split(data[start:end], np.array([0, end - start]))
        found, which = benchmark.found(part)
        last = found + benchmark.lengths[which] - 1
        out.append((words + found, which, start + part.starts[found], start + part.ends[last]))
        if end >= len(data):
            return words + len(part.starts), out
        if len(part.starts) > keep:
            move = len(part.starts) - keep
            words, start, size = words + move, start + int(part.starts[move]) if keep else end, step
        else:
            size *= 2


def _merged(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Runs of words (and bytes) that overlap or touch, joined within each owner."""
    order = np.lexsort((first, owner))
    first, last, start, end, owner = (x[order] for x in (first, last, start, end, owner))
    far = np.maximum.accumulate(last + owner * (1 << 40))  # words of a text are fewer than 2^40
    new = np.ones(len(first), bool)
    new[1:] = first[1:] + owner[1:] * (1 << 40) > far[:-1]
    heads = np.flatnonzero(new)
    return [first[heads], np.maximum.reduceat(last, heads), start[heads], np.maximum.reduceat(end, heads), owner[heads]] if len(heads) else [first, last, start, end, owner]


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"


def _span_lists(runs: list[np.ndarray], count: int) -> pa.Array:
    first, last, start, end, owner = runs
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))])
    values = pa.StructArray.from_arrays([pa.array(x) for x in (first, last, start, end)], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _scan(batches: Iterator[pa.RecordBatch], sent, limit: int) -> Iterator[pa.RecordBatch]:
    """Add n_words, spans and items to rows (row, text)."""
    benchmark: Benchmark = sent.value
    for batch in batches:
        for step in lone_steps(batch, "text", limit):
            data, edges = _bytes(step.column("text"))
            if step.num_rows == 1 and len(data) > limit:
                many, found = _long(data, benchmark, limit)
                first, which, start, end = (np.concatenate([f[k] for f in found]) for k in range(4))
                counts, owner = np.array([many]), np.zeros(len(first), np.int64)
            else:
                words = split(data, edges)
                first, which = benchmark.found(words)
                counts = np.diff(words.offsets)
                owner = np.searchsorted(words.offsets, first, "right") - 1
                start, end = words.starts[first] - edges[owner], words.ends[first + benchmark.lengths[which] - 1] - edges[owner]
                first = first - words.offsets[owner]
            spans = _span_lists(_merged(first, first + benchmark.lengths[which], start, end, owner), step.num_rows)
            yield pa.RecordBatch.from_arrays([step.column("row"), step.column("text"), pa.array(counts, pa.int64()), spans, _names(benchmark, which, owner, step.num_rows)], ["row", "text", "n_words", "spans", "items"])


def _names(benchmark: Benchmark, which: np.ndarray, owner: np.ndarray, count: int) -> pa.Array:
    """Per text the distinct names of the items whose windows it holds."""
    lists = benchmark.items.take(pa.array(which, pa.int64()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(np.stack([np.repeat(owner, sizes), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)]), axis=1) if sizes.sum() else np.zeros((2, 0), np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs[0], minlength=count))])
    values = pa.array(benchmark.names, pa.string()).take(pa.array(pairs[1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, step: int = STEP) -> DataFrame:
    """Every row and column of ``docs`` with n_words, n_hit, n_items, items, spans and contaminated.

    Texts and items are lower-cased (A-Z) and cut into words (digits, letters a-z, characters beyond ASCII). Every ``width``
    words in a row of an item are a window, or all its words if there are fewer. n_hit words of a text lie in
    an occurrence of a window; ``spans`` are the runs of these: numbers of the first word and the one behind the last,
    and of the bytes (UTF-8) from the first to behind the last. ``items`` are the ids, as strings, ascending, of the
    items with such windows, n_items their number; contaminated says n_hit > 0.

    The windows' hashes are a broadcast table that the texts' windows are looked up in, the words of every hit are
    compared. The table's size is checked: beyond ``SENT_WINDOWS`` windows or ``SENT_BYTES`` bytes the benchmark is cut by hash
    into tables of that size, each is looked for in a round of its own, and the rounds' runs of words are joined.

    A null text has no words; an item without words has no windows; items without id mark words but have no
    name; rows of one item_id are one item. Empty tables: no rows, or nothing contaminated. A text longer
    than ``step`` bytes is read in overlapping steps. Repeated rows are rows each. Columns of the six names are replaced.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    kept = [c for c in docs.columns if c not in added]
    others = [c for c in kept if c != text]
    made = stored(item_windows(benchmark, item, item_text, width), "item-windows")
    size = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 4)), F.lit(0)).alias("bytes")).first()
    rounds = max(1, -(-size.n // SENT_WINDOWS), -(-size.bytes // SENT_BYTES))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, spans {SPANS}, items array<string>"

    def looked(rows: DataFrame, part: int, schema: str) -> DataFrame:
        windows = made if rounds == 1 else made.where(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == part)
        return rows.mapInArrow(partial(_scan, sent=spark.sparkContext.broadcast(_gathered(windows.collect())), limit=step), schema)

    if rounds == 1:
        out = looked(rows, 0, schema)
    else:
        rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "decontamination-rows")
        narrow = rows.select(F.struct("key").alias("row"), "text")
        found = None
        for part in range(rounds):
            one = looked(narrow, part, f"row struct<key:long>, text string, n_words long, spans {SPANS}, items array<string>").select("row.key", "n_words", "spans", "items")
            found = one if found is None else found.unionAll(one)
        joined = found.groupBy("key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = rows.join(joined.mapInArrow(_joined, joined.schema), "key")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    out = out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items": F.array_sort("items")})
    own = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in kept]
    return out.select(*own, "n_words", "n_hit", "n_items", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the runs of several rounds."""
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        runs = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "start", "end")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), _span_lists(_merged(*runs, owner), len(lists)), batch.column("items")], batch.schema.names)


def remove(scanned: DataFrame, text: str = "text", how: str = "spans") -> DataFrame:
    """What ``scan`` found goes: the runs of words (``spans``) or whole rows (``documents``); its columns stay.

    A run is cut out from its first byte to its last, what stands between words around it stays. A null text stays null.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how must be spans or documents")
    if how == "documents":
        return scanned.where("NOT contaminated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(text), batch.column("spans").to_pylist()):
                if spans and value.is_valid:
                    raw = value.as_py().encode()
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
                    value = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                else:
                    value = value.as_py()
                out.append(value)
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return scanned.mapInArrow(run, scanned.schema)


def digest(items: Column) -> Column:
    """SHA-256 of ascending ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
