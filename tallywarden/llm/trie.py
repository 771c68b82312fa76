"""Prefix trie of conversations: z-fast tries per batch, their expanded nodes merged by prefix digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import WORD, parts, stored

#: Turns and conversations that one local trie takes up before its nodes are handed on.
BATCH_TURNS, BATCH_CONVERSATIONS = 400_000, 100_000
#: Bytes of a prefix digest; the empty prefix is all zeros.
WIDTH = 16
ROOT = bytes(WIDTH)
#: Nodes under one parent from which on the join that gives them the parent's id is spread.
MANY_CHILDREN = 100_000
#: Bytes of ids that go to the hash of a node's ends at once.
END_BYTES = 1 << 20
NODES = "key binary, parent binary, depth long, words long, n long, least long"


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


@dataclass(eq=False)
class Node:
    """A compacted node: the prefix of ``depth`` turns of the conversation whose digests are ``keys``.

    The turns from ``above`` (the parent's depth) on are its edge.
    """

    keys: bytes
    words: np.ndarray
    above: int
    depth: int
    n: int = 0
    least: int = 1 << 63
    children: dict[bytes, "Node"] = field(default_factory=dict)


class ZFastTrie:
    """A compacted trie of digest sequences, its nodes in a hash table under their handles.

    A node's handle is the prefix whose length is the 2-fattest number on its edge. Whether a prefix
    is there shows in one look-up, so the deepest node whose handle is a prefix of a conversation is found in as many look-ups as the
    logarithm of the conversation's turns (fat binary search). Digests of prefixes of unlike length differ, so a digest alone is the key.
    """

    def __init__(self) -> None:
        self.root = Node(b"", np.zeros(0, np.int64), 0, 0)
        self.handles: dict[bytes, Node] = {}
        self.looked = 0

    @staticmethod
    def key(keys: bytes, depth: int) -> bytes:
        return keys[(depth - 1) * WIDTH : depth * WIDTH] if depth else ROOT

    def exit_node(self, keys: bytes, start: Node | None = None) -> Node:
        """The node in whose edge, or at whose end, the walk along ``keys`` leaves the trie.

        ``start`` is a node that ``keys`` is known to go through.
        """
        node = start or self.root
        low, high = node.depth, len(keys) // WIDTH
        while low < high:
            at = fattest(low, high)
            self.looked += 1
            found = self.handles.get(self.key(keys, at))
            if found is None:
                high = at - 1
            else:
                node, low = found, found.depth
        if self.shared(node, keys) == node.depth:
            child = node.children.get(self.key(keys, node.depth + 1))
            return child or node
        return node

    def shared(self, node: Node, keys: bytes) -> int:
        """Turns that ``keys`` has in common with a node's prefix."""
        low, high = 0, min(node.depth, len(keys) // WIDTH)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.key(keys, middle) == self.key(node.keys, middle) else (low, middle - 1)
        return low

    def insert(self, batch: list[tuple[int, bytes, np.ndarray]]) -> None:
        """Add conversations (id, digests, words of each turn).

        All are located in the trie as it stands; those that leave it at one node go in together, from there on down.
        """
        leaving: dict[int, tuple[Node, list]] = {}
        for row in batch:
            node = self.exit_node(row[1])
            leaving.setdefault(id(node), (node, []))[1].append(row)
        for node, rows in leaving.values():
            # A node that is split keeps its lower part: what is above its edge stays above it.
            top = node if node is self.root else self._at(node, node.above)
            for number, keys, words in rows:
                self._add(top, number, keys, words)

    def _at(self, node: Node, depth: int) -> Node:
        """The node of ``depth`` that lies above ``node``."""
        if not depth:
            return self.root
        return self.exit_node(node.keys[: depth * WIDTH])

    def _add(self, top: Node, number: int, keys: bytes, words: np.ndarray) -> None:
        turns = len(keys) // WIDTH
        node = self.exit_node(keys, top)
        same = self.shared(node, keys)
        if same < node.depth:
            node = self._split(node, same)
        if same < turns:
            leaf = Node(keys, words, same, turns)
            node.children[self.key(keys, same + 1)] = leaf
            self.handles[self.key(keys, fattest(same, turns))] = leaf
            node = leaf
        node.n += 1
        node.least = min(node.least, number)

    def _split(self, low: Node, depth: int) -> Node:
        """Cut an edge: a new node of ``depth`` above ``low``; one of the two takes over the handle."""
        high = Node(low.keys, low.words, low.above, depth)
        parent = self._at(low, low.above)
        high.children[self.key(low.keys, depth + 1)] = low
        parent.children[self.key(low.keys, low.above + 1)] = high
        handle, low.above = fattest(low.above, low.depth), depth
        self.handles[self.key(low.keys, fattest(high.above, depth))] = high
        if handle <= depth:
            self.handles[self.key(low.keys, fattest(depth, low.depth))] = low
        return high

    def expanded(self) -> Iterator[tuple[Node, int, int]]:
        """Every node with its conversations and the smallest of them; a node stands for all depths of its edge."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children.values())
        totals: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            below = [totals[id(c)] for c in node.children.values()]
            totals[id(node)] = node.n + sum(n for n, _ in below), min([node.least, *(x for _, x in below)])
        for node in order:
            yield node, *totals[id(node)]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows conv_id, turn, digest (MD5 of role and text), words: what the trie needs of each turn.

    Null roles and texts become empty, rows without conv_id go.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)))
    words = F.regexp_count(said, F.lit(WORD)).cast("long")
    return conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), words.alias("words"))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its turns in order: digests of its prefixes, one after the other, and words of its turns."""
    now, held, words = None, [], []
    last = ROOT
    out: list[tuple[int, bytes, list[int]]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        rows, out, size = out, [], 0
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "keys", "words"])

    for batch in batches:
        for conv, digest, count in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")]):
            if conv != now:
                if now is not None:
                    out.append((now, b"".join(held), words))
                    size += 1 + len(words)
                    if size > 20_000:
                        yield flush()
                now, held, words, last = conv, [], [], ROOT
            if digest is not None:
                last = hashlib.md5(last + digest).digest()
                held.append(last)
                words.append(count)
    if now is not None:
        out.append((now, b"".join(held), words))
        yield flush()


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the tries of a stream of conversations; a trie is handed on and begun anew when it holds a batch."""
    trie, taken, held = ZFastTrie(), 0, 0
    for batch in batches:
        rows = list(zip(batch.column("conv_id").to_pylist(), batch.column("keys").to_pylist(), (x.values.to_numpy() for x in batch.column("words"))))
        trie.insert(rows)
        held += len(rows)
        taken += sum(len(w) for _, _, w in rows)
        if taken > BATCH_TURNS or held > BATCH_CONVERSATIONS:
            yield from _nodes(trie)
            trie, taken, held = ZFastTrie(), 0, 0
    if held:
        yield from _nodes(trie)


def _nodes(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), *[pa.int64()] * 4))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "parent", "depth", "words", "n", "least"])

    for node, n, least in trie.expanded():
        if node.depth == 0:
            rows.append((ROOT, None, 0, 0, n, least))
        for depth in range(node.above + 1, node.depth + 1):
            rows.append((trie.key(node.keys, depth), trie.key(node.keys, depth - 1), depth, int(node.words[depth - 1]), n, least))
            if len(rows) >= 10_000:
                yield flush()
    if rows:
        yield flush()


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's digests and the nodes that it stands for, what each prefix has below it along this conversation."""
    for batch in batches:
        out: list[tuple[bytes, int, int]] = []
        for keys, found in zip(batch.column("keys").to_pylist(), batch.column("found").to_pylist()):
            saved, leaves = {}, 0
            for node in found:
                saved[node["depth"]] = node["value"]
                leaves += node["leaf"]
            total = 0
            for depth in range(len(keys) // WIDTH, -1, -1):
                total += saved.get(depth, 0)
                if total or leaves:
                    out.append((ZFastTrie.key(keys, depth), total, leaves))
        if out:
            key, total, leaves = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(total, pa.int64()), pa.array(leaves, pa.int64())], ["key", "saved", "leaves"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys as comma-joined ids, with the first id of each run; no run is longer than ``END_BYTES``."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        rows = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:]) if b > a]
        if rows:
            key, first, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], ["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's runs of ids, one after the other; only the hash's state is held."""
    now, state = None, None

    def row(keys: list, marks: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.string())], ["key", "ends"])

    for batch in batches:
        keys, marks = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    marks.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield row(keys, marks)
    if now is not None:
        yield row([now], [state.hexdigest()])


def _with_parents(nodes: DataFrame, hot: int) -> DataFrame:
    """Add the parent's id. A parent with more than ``hot`` children is joined in several copies, each with a part of them.

    Fewer than (nodes / ``hot``) parents can have so many: their list is small and sent to all.
    """
    many = F.broadcast(nodes.where(F.col("n_children") > hot).select(F.col("key").alias("parent"), F.ceil(F.col("n_children") / hot).cast("int").alias("copies")))
    salt = F.pmod(F.xxhash64("key"), F.coalesce("copies", F.lit(1))).cast("int")
    children = nodes.join(many, "parent", "left").withColumn("salt", salt).drop("copies")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_children") / hot), F.lit(1)).cast("int") - 1))
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"), copies.alias("salt"))
    return children.join(above, ["parent", "salt"], "left")


def trie(said: DataFrame, hot: int = MANY_CHILDREN) -> DataFrame:
    """Rows conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one per distinct prefix.

    ``said`` has rows (conv_id, turn, digest, words); a row without digest says only that the conversation is there.

    1. Turns are brought together by conversation, in order of turn (null first, then digest), and each prefix gets a digest
       that continues the one before. One task reads a conversation as a stream, and holds 16 bytes for each of its turns.
    2. Conversations are range-sorted by their first digests, so that those which begin alike stand together, however many they are. Tasks
       insert them in batches into z-fast tries and hand on the expanded nodes with counts: what a third
       of all conversations shares is one row per trie, not one per conversation.
    3. Nodes are merged by digest. Then each node's own savings and each childless node are given to its smallest
       conversation, which carries them up its prefixes (sums, combined before the shuffle): no round per depth.
    4. The ids of the conversations that end at a node are sorted across tasks, joined to runs, and the runs of a node are hashed as
       a stream: no list of them is held.

    Prefixes are told apart by 128-bit digests. Conversations without any turn are members of the root only. Without conversations there is no row.
    """
    spark = said.sparkSession
    dealt = said.select("conv_id", "turn", "digest", "words").repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    rows = stored(dealt.mapInArrow(_sequences, "conv_id long, keys binary, words array<long>"), "sequences")
    near = rows.repartitionByRange(parts(spark), F.substring("keys", 1, 4 * WIDTH), "conv_id").sortWithinPartitions(F.substring("keys", 1, 4 * WIDTH), "conv_id")
    made = near.mapInArrow(_tries, NODES)
    firsts = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
    nodes = stored(made.groupBy("key").agg(*firsts, F.sum("n").alias("n"), F.min("least").alias("least")), "trie-nodes")
    own = nodes.select("key", "parent", "depth", "words", "n", "least", F.lit(0).alias("child"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "binary"), ("depth", "long"), ("words", "long"), ("n", "long"), ("least", "long"))]
    marks = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("key"), *none, F.lit(1).alias("child"))
    kept = [F.max(c).alias(c) for c in ("parent", "depth", "words", "n", "least")]
    nodes = stored(own.unionAll(marks).groupBy("key").agg(*kept, F.sum("child").alias("n_children")), "trie-children")

    value = ((F.col("n") - 1) * F.col("words")).alias("value")
    stands = nodes.select(F.col("least").alias("conv_id"), F.struct("depth", value, (F.col("n_children") == 0).cast("int").alias("leaf")).alias("node"))
    stands = stands.where("node.value > 0 OR node.leaf > 0").groupBy("conv_id").agg(F.collect_list("node").alias("found"))  # prefixes of one conversation
    sums = rows.select("conv_id", "keys").join(stands, "conv_id").select("keys", "found").mapInArrow(_below, "key binary, saved long, leaves long")
    sums = sums.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    last = F.when(F.length("keys") > 0, F.substring(F.col("keys"), -WIDTH, WIDTH)).otherwise(F.lit(bytearray(ROOT)))
    ends = rows.select(last.alias("key"), "conv_id").repartitionByRange(parts(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ends = ends.mapInArrow(_pieces, "key binary, first long, ids string").repartition(parts(spark), "key").sortWithinPartitions("key", "first")
    ends = ends.mapInArrow(_hashed, "key binary, ends string")

    out = _with_parents(nodes, hot).join(sums, "key").join(ends, "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The ``trie`` of a table of turns; other columns are not read.

    Turns stand in order of ``turn``, null first, equal ones in order of the MD5 of role and text. Null roles and texts are
    empty, empty and very long texts are turns like others, rows without conversation id take no part, repeated rows are turns each.
    """
    return trie(turns(conversations, conv, turn, role, text))


def rebuilt(said: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin alike: each c opens with the first h turns of conversation c - c % ``group`` and goes on with its own after h.

    h is the CRC-32 of c in decimals modulo ``most``. Rows like ``said``, and one without digest per conversation, so that
    those without any turn stay. ``turn`` is the position from 1.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = said.withColumn("turn", F.row_number().over(order).cast("long"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    own = placed.where(F.col("turn") > h)
    all_of = said.select("conv_id").distinct()
    firsts = placed.where((F.col("conv_id") % group == 0) & (F.col("turn") < most)).withColumnRenamed("conv_id", "base")
    begun = all_of.select("conv_id", h.alias("h"), base.alias("base")).join(firsts, "base").where("turn <= h").select("conv_id", "turn", "digest", "words")
    there = all_of.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(begun).unionByName(there)
