"""Benchmark windows in documents against brute force and SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.conftest import prose
from tests.llm.test_documents import same

from tallywarden.llm import decontam, queries, sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [(m.group(), m.span()) for m in WORD.finditer(lowered)]


def brute(text, items, width=10):
    """Number of words, numbers of the hit ones, ids of the items."""
    own = words(text)
    hit, names = set(), set()
    for name, item in items:
        w = [x for x, _ in words(item)]
        for i in range(max(1, len(w) - width + 1) if w else 0):
            part = w[i : i + width]
            for k in range(len(own) - len(part) + 1):
                if [x for x, _ in own[k : k + len(part)]] == part:
                    hit |= set(range(k, k + len(part)))
                    names |= {str(name)} if name is not None else set()
    return len(own), hit, sorted(names)


ITEMS = [
    (1, prose(3, 25)), (2, prose(4, 10)), (10, prose(5, 12)), (3, "Two WORDS"), (4, "single"), (5, ""), (6, None), (7, " -- "), (None, prose(6, 14)),
    (1, prose(7, 11)), (8, "Çà et là é ÉTÉ 中文 ok x1 2y z3 w4 v5 u6"), (9, prose(3, 25)), (11, "a a a a a a a a a a a"),
]
SPREAD = " , ".join(prose(3, 25).upper().split())
DOCS = [
    (1, f"before {prose(3, 25)} after"), (2, prose(3, 9)), (3, SPREAD), (3, SPREAD), (4, None), (5, ""), (None, prose(4, 10)), (6, prose(6, 14)),
    (7, f"{prose(4, 9)}\n{prose(5, 12)[:-1]}"), (8, "two words and two  words; single-handed"), (9, "çà et là é ÉTÉ 中文 ok x1 2y z3 w4 v5 u6 more"),
    (10, "Çà et là é ÉTÉ 中文 ok x1 2y z3 w4 v5 u6 more"), (11, " ".join("a" * 30)), (12, "\x00\x7f{}" + prose(7, 11) + "\x00"), (13, f"{prose(9, 3000)} {prose(3, 12)} {prose(9, 3000)} {prose(7, 11)}"),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in DOCS], "doc_id long, text string, items string, row long")
    return docs, spark.createDataFrame([(i, t, 1.5) for i, t in ITEMS], "item_id long, text string, n_words double")


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in df.collect()), key=str)


def want():
    out = []
    for i, text in DOCS:
        n, hit, names = brute(text, ITEMS)
        out.append((i is None, i or 0, n, len(hit), len(names), names, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits,step", [({}, 2_000_000), ({"SENT_WINDOWS": 9}, 2_000_000), ({}, 200), ({"SENT_BYTES": 900}, 60)])
def test_equals_brute_force(tables, monkeypatch, limits, step):
    """Also in rounds, and with texts that are longer than a step."""
    for name, value in limits.items():
        monkeypatch.setattr(decontam, name, value)
    found = decontam.scan(*tables, step=step)
    assert got(found) == want()
    assert found.columns == ["doc_id", "text", "row", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"]


def test_steps_of_a_long_text():
    random.seed(2)
    vocabulary = ["ab", "c", "é", "x" * 300, "9"]
    for _ in range(60):
        text = " ".join(random.choice(vocabulary) for _ in range(random.randrange(1, 60)))
        items = [(n, " ".join(random.choice(vocabulary[:3]) for _ in range(random.choice([1, 2, 4])))) for n in range(3)]
        rows = {}
        for name, item in items:
            w = decontam.split(*arrays(item))
            length = len(w.starts)
            value = next(v for n, v in decontam.windows(w.hashes, [length]))[0]
            rows.setdefault(item, {"hash": int(np.uint64(value).view(np.int64)), "length": length, "words": item.encode(), "items": []})["items"].append(str(name))
        bench = decontam._gathered(list(rows.values()))
        many, parts = decontam._long(np.frombuffer(text.encode(), np.uint8), bench, 50)
        hit = {k for first, which, _, _ in parts for a, n in zip(first, which) for k in range(a, a + bench.lengths[n])}
        assert (many, hit) == brute(text, items, 10)[:2]


def arrays(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_words_do_not_cross_texts():
    data = np.frombuffer("abcd ef".encode(), np.uint8)
    w = decontam.split(data, np.array([0, 2, 2, 4, 7]))
    assert (w.starts.tolist(), w.ends.tolist(), w.offsets.tolist()) == ([0, 2, 5], [2, 4, 7], [0, 1, 1, 2, 3])
    again = decontam.split(np.frombuffer(b"ef ab", np.uint8), np.array([0, 5]))
    assert again.hashes.tolist() == [w.hashes[2], w.hashes[0]]


def test_equal_hashes_of_unlike_words_are_told_apart(tables, monkeypatch):
    """With hashes of four values everything meets everything, and the words decide."""
    whole = decontam.windows
    monkeypatch.setattr(decontam, "windows", lambda h, n: ((k, (v >> np.uint64(62)) << np.uint64(62)) for k, v in whole(h, n)))
    made = decontam.item_windows(tables[1]).collect()
    # The monkeypatched rule holds in this process only: the scan is called here, without Spark.
    bench = decontam._gathered([r.asDict() | {"hash": 0} for r in made])
    monkeypatch.setattr(decontam, "windows", lambda h, n: ((k, v * np.uint64(0)) for k, v in whole(h, n)))
    for _, text in DOCS[:12]:
        w = decontam.split(*arrays(text or ""))
        at, which = bench.found(w)
        hit = {k for a, n in zip(at, which) for k in range(a, a + bench.lengths[n])}
        assert hit == brute(text, ITEMS)[1]


def test_removal(tables):
    found = decontam.scan(*tables)
    rows = {r.doc_id: r.text for r in decontam.remove(found).collect()}
    assert rows[1] == "before  after" and rows[4] is None and rows[5] == "" and rows[2] == prose(3, 9)
    assert rows[9] == "çà  more"  # capitals beyond ASCII are letters of their own
    assert rows[10] == " more" and rows[8] == " and -handed"  # runs that touch are one
    assert all(n == 0 for _, _, _, n, *_ in got(decontam.scan(decontam.remove(found), tables[1])))
    kept = decontam.remove(found, how="documents")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in DOCS if i and not brute(t, ITEMS)[1])
    with pytest.raises(ValueError):
        decontam.remove(found, how="words")


def test_empty_tables(tables):
    docs, items = tables
    assert decontam.scan(docs.where("false"), items).count() == 0
    none = decontam.scan(docs, items.where("false")).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none) and {r.n_words for r in none} == {len(words(t)) for _, t in DOCS}


def test_query_equals_sql(spark, duck, tables, work):
    folder = "/root/testdata/sf0.01"
    con = duck(documents=spark.read.parquet(f"{folder}/documents.parquet"), benchmark=spark.read.parquet(f"{folder}/benchmark.parquet"))
    found = queries.op12_decontam(spark, folder)
    assert same(found, con.sql(sql.LEAKS)) and found.where("contaminated").count() > 0
    for name, df in zip(("documents", "benchmark"), tables):
        df.write.parquet(f"{work}/{name}.parquet")
    assert same(queries.op12_decontam(spark, work), duck(documents=tables[0], benchmark=tables[1]).sql(sql.LEAKS))
    none = [r.items_sha256 for r in queries.op12_decontam(spark, work).where("n_items = 0").collect()]
    assert set(none) == {hashlib.sha256(b"").hexdigest()}
