"""The prefix trie against brute force and SQL."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.test_documents import same

from tallywarden.llm import queries, sql, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def paths(rows):
    """Turns (role, text) per conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in out.items()}


def rebuild(own):
    out = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def brute(convs):
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), children.get(p, 0), sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Few unlike turns, so that much is shared; nulls, ties, repeated rows, one long conversation, equal ones, negative ids."""
    random.seed(5)
    out = []
    for c in [*range(0, 130), *range(-45, -20), 1000, 1001, 2021]:
        out += [(c, t, random.choice(["user", "bot"]), random.choice(["a b", "c", "", "d  e f"])) for t in range(random.choice([1, 1, 2, 3, 5, 9]))]
    out += [(500 + k, t, "user", f"same {t} thing") for k in range(60) for t in range(4)]
    out += [(700, t, "user", f"long {t % 7}") for t in range(300)]
    out += [(701, t, "user", f"long {t % 7}") for t in range(300) if t != 150]
    out += [(None, 0, "user", "x"), (1, None, None, None), (1, 3, None, "z"), (1, 3, "z", None), (1, 3, "z", ""), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 1, "u", "w " * 50_000)]
    return out


@pytest.fixture
def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def test_plain_equals_brute_force(table, rows):
    assert got(trie.prefix_trie(table)) == brute(paths(rows))


@pytest.mark.parametrize("hot", [100_000, 2])
def test_rebuilt_equals_brute_force(table, rows, hot):
    convs = rebuild(paths(rows))
    assert any(not said for said in convs.values())
    assert got(trie.trie(trie.rebuilt(trie.turns(table)), hot=hot)) == brute(convs)


def test_local_tries_find_and_split():
    """Batches of all sizes give the nodes of a plain trie; exit nodes come from few look-ups."""
    random.seed(1)
    for size in (1, 3, 50):
        z, convs = trie.ZFastTrie(), {}
        said = []
        for c in range(150):
            base = random.choice(list(convs.values())) if convs and random.random() < 0.8 else []
            turns = base[: random.randrange(len(base) + 1)] + [("u", random.choice("abc")) for _ in range(random.randrange(6))]
            convs[c] = turns
            keys, last = b"", trie.ROOT
            for t in turns:
                last = hashlib.md5(last + digest(*t)).digest()
                keys += last
            said.append((c, keys, np.ones(len(turns), np.int64)))
        for i in range(0, len(said), size):
            z.insert(said[i : i + size])
        found = sorted((depth, n, least) for node, n, least in z.expanded() for depth in (range(node.above + 1, node.depth + 1) if node.depth else [0]))
        assert found == sorted((r[1], r[3], r[0]) for r in brute(convs))
        compacted = list(z.expanded())
        assert all(node is z.root or node.n or len(node.children) > 1 for node, _, _ in compacted)  # no node without need
        handles = [node for node, _, _ in compacted if node is not z.root]
        assert len(z.handles) >= len(handles)
        for node in handles:
            assert z.handles[z.key(node.keys, trie.fattest(node.above, node.depth))] is node
        z.looked = 0
        for _, keys, _ in said:
            assert z.exit_node(keys).n and z.shared(z.exit_node(keys), keys) == len(keys) // trie.WIDTH
        most = max(len(t) for t in convs.values())
        assert z.looked <= 2 * len(said) * (most.bit_length() + 1)


def test_fattest():
    for a in range(40):
        for b in range(a + 1, 60):
            assert trie.fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_many_batches(table, rows, monkeypatch):
    """Tries that are handed on after a few turns are merged to the same nodes."""
    convs = paths(rows)
    seen = []
    monkeypatch.setattr(trie, "BATCH_TURNS", 20)
    for n in (1, 7):
        said = []
        for c in sorted(convs):
            keys, last = b"", trie.ROOT
            for t in convs[c]:
                last = hashlib.md5(last + digest(*t)).digest()
                keys += last
            said.append((c, keys, [len(t[1].split()) for t in convs[c]]))
        import pyarrow as pa

        columns = [pa.array([s[k] for s in said], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))]
        whole = pa.RecordBatch.from_arrays(columns, ["conv_id", "keys", "words"])
        merged = {}
        for batch in trie._tries(whole.slice(i, n) for i in range(0, len(said), n)):
            for r in batch.to_pylist():
                old = merged.get(r["key"], (0, 1 << 63))
                merged[r["key"]] = (old[0] + r["n"], min(old[1], r["least"]), r["depth"])
        seen.append(sorted((d, n, x) for n, x, d in merged.values()))
    assert seen[0] == seen[1] == sorted((r[1], r[3], r[0]) for r in brute(convs))


def test_empty(table):
    none = table.where("false")
    assert got(trie.prefix_trie(none)) == [] and got(trie.trie(trie.rebuilt(trie.turns(none)))) == []
    assert got(trie.prefix_trie(table.where("conv_id IS NULL"))) == []


def test_query_equals_sql(spark, duck, table, work):
    folder = "/root/testdata/sf0.01"
    con = duck(conversations=spark.read.parquet(f"{folder}/conversations.parquet"))
    assert same(queries.op13_trie(spark, folder), con.sql(sql.PREFIXES))
    table.write.parquet(f"{work}/conversations.parquet")
    few = table.where("conv_id NOT IN (700, 701)")
    few.write.parquet(f"{work}/few/conversations.parquet")
    assert same(queries.op13_trie(spark, f"{work}/few"), duck(conversations=few).sql(sql.PREFIXES))
