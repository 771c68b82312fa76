"""Near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.shared import WORD, components, parts, shuffled, split_words, stored, strings, text_steps

#: Values that a sketch retains.
KEEP = 32
#: A pair goes on if the sketch of its union holds this share of common values at least. At Jaccard
#: 0.85 the share is 27.2 of 32 on average with a deviation of 2.0; 18 lies 4.6 deviations below.
OVERLAP = 0.56
#: The same for Jaccard 0.8: 25.6 on average with a deviation of 2.3; 16 lies 4.5 deviations below.
OVERLAP_80 = 0.47
#: Documents, and shingles, that one task compares with each other at once.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Up to so many documents of loose groups (200 bytes each in the driver) their names are sent to the texts; beyond, the texts are shuffled to them.
FEW_MEMBERS = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of every text, ascending within each, and the texts' offsets."""
    words, offsets = split_words(pc.ascii_lower(strings(texts)))
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    hashes = hashes[coded.indices.to_numpy()]
    counts = np.diff(offsets)
    sizes = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = offsets[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.minimum(counts, width)[owner]
    value = _mix(length.astype(np.uint64))
    for k in range(width):
        inside = k < length
        value[inside] = _mix((value[inside] ^ hashes[first[inside] + k]) + np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))])
    return value[new], ends


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch], width: int, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in text_steps(batch, "text"):
            values, ends = shingles(step.column("text"), width)
            sizes = np.diff(ends)
            rank = np.arange(len(values)) - np.repeat(ends[:-1], sizes)
            kept = np.concatenate([[0], np.cumsum(np.minimum(sizes, keep))])
            marks = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("th"), pa.array(sizes), pa.array(marks, pa.binary()), _lists(values[rank < keep], kept)], ["doc_id", "th", "n", "mark", "sketch"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with the rows of each group of a stream that is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows > 1:
            a, b = work(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if now != key and held:
                yield from done()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def _joined(ids: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links from every row to the smallest id that ``near`` reaches; rows once reached are not compared again."""
    left = np.arange(len(ids))
    ends: list[np.ndarray] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        group = list(todo)
        while todo and len(left):
            hit = near(todo.pop(), left)
            group += left[hit].tolist()
            todo += left[hit].tolist()
            left = left[~hit]
        if len(group) > 1:
            ends.append(ids[group])
    if not ends:
        return ids[:0], ids[:0]
    return np.concatenate(ends), np.concatenate([np.full(len(x), x.min()) for x in ends])


def _alike_sketches(rows: pa.Table, keep: int, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose union sketch estimates enough in common."""
    ids, lists = rows["id"].to_numpy(), rows["sketch"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    grid = np.full((len(ids), keep), np.iinfo(np.uint64).max, np.uint64)
    grid[np.arange(keep) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    grid.sort(axis=1)
    sizes = np.minimum(sizes, keep)

    def near(row: int, left: np.ndarray) -> np.ndarray:
        both = np.sort(np.concatenate([grid[left], np.broadcast_to(grid[row], (len(left), keep))], axis=1), axis=1)
        same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.uint64).max)
        rank = np.cumsum(~np.concatenate([np.zeros((len(left), 1), bool), same], axis=1), axis=1)[:, 1:]  # place in the union
        whole = np.maximum(sizes[row], sizes[left])
        return np.count_nonzero(same & (rank <= whole[:, None]), axis=1) >= overlap * whole

    return _joined(ids, near)


def _alike_sets(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose whole sets have 100 x intersection >= percent x union."""
    ids, lists = rows["id"].to_numpy(), rows["shingles"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    distinct, codes = np.unique(lists.values.to_numpy(), return_inverse=True)
    codes = codes[offsets[0] :]
    offsets = offsets - offsets[0]
    mark = np.zeros(len(distinct), np.int64)

    def near(row: int, left: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[left], sizes[row]), np.maximum(sizes[left], sizes[row])
        out = 100 * small >= percent * large
        some = left[out]
        if len(some):
            mark[codes[offsets[row] : offsets[row + 1]]] = 1
            starts = np.cumsum(sizes[some]) - sizes[some]
            at = np.repeat(offsets[some] - starts, sizes[some]) + np.arange(sizes[some].sum())
            common = np.add.reduceat(mark[codes[at]], starts)
            mark[codes[offsets[row] : offsets[row + 1]]] = 0
            out[out] = 100 * common >= percent * (sizes[some] + sizes[row] - common)
        return out

    return _joined(ids, near)


def _blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Deal a group's rows out to all pairs of its blocks; a group of one block stays as it is.

    ``blocks`` is a column with the group's number of blocks; every two rows meet in one task at least.
    """
    own = F.pmod(F.xxhash64("id"), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rows = rows.withColumn("own", own).select("*", other.alias("other"))
    rows = rows.where((F.col(blocks) == 1) | (F.col("own") != F.col("other")))
    pair = [group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    return rows.select(*pair, *[c for c in rows.columns if c not in (group, blocks, "own", "other")])


def _compare(rows: DataFrame, group: str, work: Callable) -> DataFrame:
    keys = [group, "i", "j"]
    dealt = rows.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _grouped(batches, keys, work), "a long, b long")


def _document(text: str) -> list[Column]:
    """doc_id and the text's MD5: both together name a document whose id is missing or not its own."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("th")]


def _named() -> list[Column]:
    """doc_id and th as columns without null, null ids last."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("th")]


def _groups(docs: DataFrame, text: str, width: int, percent: int, keep: int, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, mark), one per row of ``docs``; and (mark, grp, first), one per class: its group and the group's first document.

    ``first`` is (no_id, key, th): the smallest doc_id and text hash, documents without id last.
    """
    texts = docs.select(*_document(text), F.col(text).cast("string").alias("text"))
    made = texts.mapInArrow(partial(_sketches, width=width, keep=keep), "doc_id long, th binary, n long, mark binary, sketch array<long>")
    made = stored(made, "sketches")
    classes = made.where("n > 0").groupBy("mark").agg(F.min(F.struct(*_named())).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    values = classes.select("id", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    rare = values.join(shuffled(shared), "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("found"))
    size = F.size("sketch")
    lists = size - F.ceil(size * overlap).cast("int") + 1 - (size - F.size("found"))  # the others are rarer still
    keyed = classes.join(shuffled(rare), "id").select("id", "sketch", F.when(lists > 0, F.slice("found", F.lit(1), lists)).alias("found"))
    keyed = stored(keyed.where("found IS NOT NULL"), "prefixes").select("id", "sketch", F.explode("found.value").alias("value"))
    many = keyed.groupBy("value").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members")
    loose = _compare(_blocks(keyed.join(shuffled(many), "value"), "value", "blocks"), "value", partial(_alike_sketches, keep=keep, overlap=overlap))
    groups = components(loose, "loose")

    members = classes.select("id", "n", "first").join(shuffled(groups.select(F.col("node").alias("id"), F.col("label").alias("grp"))), "id")
    cost = members.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    members = stored(members.join(shuffled(cost), "grp").select("id", "grp", "blocks", "first.*"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, "text"):
                found, ends = shingles(step.column("text"), width)
                yield pa.RecordBatch.from_arrays([step.column("id"), step.column("grp"), step.column("blocks"), _lists(found, ends)], ["id", "grp", "blocks", "shingles"])

    members = F.broadcast(members) if members.count() <= FEW_MEMBERS else shuffled(members)
    one = texts.select(*_named(), "text").join(members, ["no_id", "key", "th"])
    one = one.groupBy("id", "grp", "blocks").agg(F.first("text").alias("text"))  # repeated rows, combined before the shuffle
    full = one.mapInArrow(sets, "id long, grp long, blocks long, shingles array<long>")
    links = _compare(_blocks(full, "grp", "blocks"), "grp", partial(_alike_sets, percent=percent))
    reached = components(links, "linked")

    labels = classes.select("mark", "id", "first").join(shuffled(reached.withColumnRenamed("node", "id")), "id", "left")
    labels = labels.select("mark", F.coalesce("label", "id").alias("grp"), "first")
    firsts = labels.groupBy("grp").agg(F.min("first").alias("first"))
    return made.select("doc_id", "n", "mark"), labels.drop("first").join(shuffled(firsts), "grp")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 85, keep: int = KEEP, overlap: float = OVERLAP) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept: one per row of ``docs``.

    1. Every whole text becomes its set of hashed shingles (A-Z lower-cased); the ``keep`` smallest
       hashes are its sketch. Equal sets are one class.
    2. Sketch values that two classes hold form inverted lists. A pair must share ``overlap`` of its
       sketch, so it meets in one of the lists of each one's rarest values (those beyond
       1 - overlap cannot all be missed), and the lists of passages that very many documents share
       are left out without a cap.
    3. In a list, pairs whose union sketch estimates ``overlap`` or more are joined to loose groups.
    4. In a loose group whole sets are compared: 100 x intersection >= percent x union links. Large
       lists and groups are cut into blocks and every two blocks meet, so no task holds more than
       two blocks; a task returns one link a row, to the smallest id it reaches there, never all pairs.
    5. component_id is the smallest doc_id that links reach, kept says that it is the row's own.

    A text without words is linked with nothing and kept. Rows without doc_id link like others but give no component its
    id: where no row of a component has one, component_id is null and its rows are kept. Repeated rows are in one class
    and share the answer; where a doc_id has several texts, each row gets its own text's component. Other columns are not read.
    """
    made, groups = _groups(docs, text, width, percent, keep, overlap)
    least = F.when(~F.col("first.no_id"), F.col("first.key"))
    out = made.join(shuffled(groups.select("mark", least.alias("component_id"))), "mark", "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 85, keep: int = KEEP, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group stays, with all their columns.

    It is the one with the smallest doc_id (null last) and then text hash; of rows that agree in both one stays. So unlike
    texts under one id both stay, and of like texts without id one does. Rows without words are in no group: all stay.
    """
    _, groups = _groups(docs, text, width, percent, keep, overlap)
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != text])))
    worded = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), rest.alias("rest"), worded.alias("worded"), *_document(text))
    one = rows.where("worded").select("row", "rest", *_named()).groupBy("no_id", "key", "th").agg(F.min_by("row", "rest").alias("row"))
    stay = one.join(shuffled(groups.select("first.*").distinct()), ["no_id", "key", "th"], "left_semi")
    return stay.select("row.*").unionAll(rows.where("NOT worded").select("row.*"))
