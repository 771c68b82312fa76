"""Encoding, token files, packing, token counts: exact round trips."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywarden.llm import binary, packing, token_counts
from tallywarden.llm.encode import WordEncoder
from tallywarden.session import new_folder


def sort_key(r):
    return (r[0] is None, r[0] or 0)


@pytest.fixture(scope="module")
def plain_ids(odd_rows):
    from tallywarden.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary())
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]


def test_words_of_letters_are_encoded_together(words):
    """Hundreds of new words of letters are one text for the tokenizer, and each gets the ids it has alone."""
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    rng = random.Random(5)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzßàéîñöøþÿµªºABCÀÉ", k=rng.randint(1, 12))) for _ in range(3000)]
    odd = ["don't", "it's", "x1", "日本", "e\u0301a", "ﬁne", "\u0301", "ǆ", "IJ", "ĳ", "a\u200db", "ʼn", "ŉ", "'s", "ſt", "Ωmega"]
    texts = [" ".join(rng.sample(letters, 400) + rng.sample(odd, 8)) for _ in range(12)]
    encoder, t = WordEncoder(words), Tokenizer.from_file(words)
    encoder.tokenizer = Counted(t)
    ids, starts = encoder.encode(pa.array(texts), 2)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids + [2]
    assert encoder.tokenizer.texts < 100
    encoder = WordEncoder(words)
    encoder.last = None  # a vocabulary that marks no ends
    assert np.array_equal(encoder.encode(pa.array(texts), 2)[0], ids)


def test_word_memory_changes_no_id(words, odd_rows):
    small, t = WordEncoder(words, memory=5), Tokenizer.from_file(words)
    texts = [r[1] for r in odd_rows] + ["It's O'Neil's, U.S.A. Don'T. x., ,.. <|ENDOFTEXT|>, a<|endoftext|>.B", "İstanbul ΣΑΣ. é. É,", "x y z ÀÉ. ẞ, µ² ½. 3.5, 1,000."]
    for a in range(0, len(texts), 3):
        ids, starts = small.encode(pa.array(texts[a : a + 3]), 9)
        for i, x in enumerate(texts[a : a + 3]):
            assert ids[starts[i] : starts[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [9]


@pytest.mark.parametrize("n,universe", [(0, 0), (1, 5), (300, 300), (1000, 10**6), (999, 10**9)])
def test_elias_fano(n, universe):
    ends = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    x = binary.EliasFano.build(ends, universe)
    assert x.range(0, n).tolist() == ends.tolist() == [x.end(i) for i in range(n)]
    for a, b in np.sort(np.random.default_rng(1).integers(0, n + 1, (40, 2))).tolist():
        assert x.range(a, b).tolist() == ends[a:b].tolist()
    if n == 1000:
        assert 8 * (x.low.nbytes + x.high.nbytes) < n * (2 + np.log2(universe / n)) + 64
    with pytest.raises(IndexError):
        x.select(n)


@pytest.mark.parametrize("shard_ids", [1, 500, 10**7])
def test_files_round_trip(spark, odd, words, plain_ids, shard_ids):
    folder = new_folder(spark, "ids")
    binary.write_ids(odd, folder, words, end=2, shard_ids=shard_ids)
    got = binary.read_ids(spark, folder).collect()
    want = sorted([(k, v + [2]) for k, v in plain_ids], key=sort_key)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=lambda r: (*sort_key(r), r[1])) == sorted(want, key=lambda r: (*sort_key(r), r[1]))
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [k for k, _ in want]
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens


def test_shard_random_access(words):
    ids = np.arange(100, dtype=np.uint32)
    shard = binary.Shard(binary.write_shard([5, 9, None], ids, np.array([10, 10, 100]), 2, 3, 4) + b"\n")
    assert (shard.part, shard.shard, [shard.doc_id(i) for i in range(3)]) == (3, 4, [5, 9, None])
    assert [shard.document(i).tolist() for i in range(3)] == [list(range(10)), [], list(range(10, 100))]
    with pytest.raises(ValueError):
        binary.Shard(b"x" * 100)


@pytest.mark.parametrize("keys", [[], [None, None], [7], [-(1 << 63), -5, -5, 0, 3, (1 << 63) - 1, None], list(range(-300, 900, 3)) + [None] * 5])
def test_doc_ids_of_a_shard(keys):
    ends = np.arange(1, len(keys) + 1)
    data = binary.write_shard(keys, np.zeros(len(keys), np.uint32), ends, 2, 0, 0)
    shard = binary.Shard(data)
    assert shard.doc_ids(0, len(keys)).to_pylist() == keys == [shard.doc_id(i) for i in range(len(keys))]
    assert shard.lines.range(0, len(keys)).tolist() == ends.tolist()


def test_little_space_per_document(spark, words):
    """Beyond the ids a document takes less than three bytes, and every shard has its first bytes beside it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 400")
    folder = new_folder(spark, "ids")
    binary.write_ids(docs, folder, words, shard_ids=40_000)
    files = spark.read.format("binaryFile").load(folder).collect()
    heads, shards = ([f for f in files if (f.length == binary.HEAD_BYTES + 1) == small] for small in (True, False))
    assert len(heads) == len(shards) > 1 and {bytes(f.content[: binary.HEAD_BYTES]) for f in shards} == {bytes(f.content[:-1]) for f in heads}
    read = [binary.Shard(bytes(f.content)) for f in shards]
    beyond = sum(f.length - x.ids.nbytes - binary.HEAD_BYTES - 1 for f, x in zip(shards, read))
    assert sum(x.n for x in read) == docs.count() and beyond < 3 * docs.count()


def test_no_documents(spark, none, words):
    folder = new_folder(spark, "ids")
    binary.write_ids(none, folder, words)
    assert binary.read_ids(spark, folder).count() == 0
    assert packing.pack(none, words).count() == 0
    assert token_counts.count(none, *bytes_of()).count() == 0


def test_differencing():
    assert sorted(map(sorted, packing.differencing([8, 7, 6, 5, 4], 2))) == [[0, 2], [1, 3, 4]]  # 14 and 16
    assert packing.differencing([], 3) == [[], [], []]
    random.seed(1)
    for _ in range(30):
        sizes = [random.randint(1, 512) for _ in range(random.randint(1, 300))]
        found = packing.windows(sizes, 2048)
        assert sorted(i for w in found for i in w) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in w) for w in found) <= 2048
        assert len(found) <= -(-sum(sizes) // 2048) + 1


def test_window_count_rises():
    assert len(packing.windows([3, 3, 3], 5)) == 3  # the bound is 2, but no two fit


def check_pieces(rows, want, capacity):
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id, r.doc_tokens].append(r)
    for pieces in sequences.values():
        ends = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == ends and r.length > 0
            ends += r.length
        assert ends <= capacity
    counts = defaultdict(int)
    for key, ids in want:
        counts[key, len(ids)] += 1
    for key, ids in want:
        pieces = sorted(documents[key, len(ids)], key=lambda r: r.start)
        n = counts[key, len(ids)]
        starts = pieces[::n]
        assert b"".join(r.ids for r in starts) == np.array(ids, "<u4").tobytes() or n > 1
        assert sum(r.length for r in pieces) == n * len(ids)
    return 1 - sum(r.length for r in rows) / capacity / len(sequences)


def test_packing(odd, words, plain_ids):
    want = [(k, v + [1]) for k, v in plain_ids]
    check_pieces(packing.pack(odd, words, piece=100, group=20).collect(), want, 2048)
    check_pieces(packing.pack(odd, words, capacity=64, piece=64).collect(), want, 64)


def test_padding_is_small(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = packing.pack(docs, words).drop("ids").collect()
    sequences = {r.sequence_id for r in rows}
    assert 1 - sum(r.length for r in rows) / 2048 / len(sequences) < 0.015


def bytes_of():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    random.seed(5)
    for _ in range(200):
        n = random.randint(1, 30)
        tokens = np.unique(np.append(np.array(random.sample(range(1, n + 1), random.randint(1, n))), n))
        sections = np.append(np.sort([random.randint(0, n) for _ in range(random.randint(0, 5))]), n).astype(int)
        own, crossing = token_counts.attribute(tokens, sections, rule)
        want, over, bounds = [0] * len(sections), [0] * len(sections), [0, *sections.tolist()]
        for a, b in zip([0, *tokens.tolist()], tokens.tolist()):
            parts = [max(0, min(b, y) - max(a, x)) for x, y in zip(bounds, bounds[1:])]
            hit = [i for i, p in enumerate(parts) if p]
            k = {"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda i: (parts[i], -i))}[rule]
            want[k] += 1
            over[k] += len(hit) > 1
        assert (own.tolist(), crossing.tolist()) == (want, over)


def test_counts_tile_documents(odd, odd_rows):
    path, pattern = bytes_of()
    encode = token_counts.byte_tokens(path, pattern).encoding.encode_ordinary
    rows = defaultdict(list)
    for r in token_counts.count(odd, path, pattern, section_end=token_counts.SENTENCE).collect():
        rows[r.doc_id].append(r)
    for key in {r[0] for r in odd_rows}:
        texts = [r[1] or "" for r in odd_rows if r[0] == key]
        assert sum(r.length for r in rows[key]) == sum(map(len, texts))
        assert sum(r.n_tokens for r in rows[key]) == sum(len(encode(t)) for t in texts)
    assert [(r.section, r.length, r.n_tokens) for r in rows[3]] == [(0, 0, 0)]


def test_counts_of_fields(odd, odd_rows):
    path, pattern = bytes_of()
    encode = token_counts.byte_tokens(path, pattern).encoding.encode_ordinary
    rows = token_counts.count(odd.where("doc_id = 8"), path, pattern, fields=["lang", "source", "text"], separator=" ", rule="last").collect()
    assert [(r.field, r.start, r.length) for r in rows] == [("lang", 0, 3), ("source", 3, 2), ("text", 5, 16)]
    assert sum(r.n_tokens for r in rows) == len(encode("en a Only three words"))
    with pytest.raises(ValueError):
        token_counts.count(odd, path, pattern, rule="none")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_per_section_equal_brute_force(spark, rule):
    """Whole results, token by token and character by character, with characters of several bytes at the sections' ends."""
    path, pattern = bytes_of()
    encoding = token_counts.byte_tokens(path, pattern).encoding
    texts = ["Été. 日本語です! 🎉🎉 é?\t\tñandú\n\n🎉.", "🎉\n🎉 🎉! 🧑‍🚀.", "a.b. c.  d\n", "\n\n\n", "ﷺ. ﷺ! ﷺ", "one", "", "x" * 50 + ".\n" + "é" * 9]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select("text").collect()][:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in token_counts.count(docs, path, pattern, section_end=token_counts.SENTENCE, rule=rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.start, r.length, r.n_tokens, r.n_crossing))
    for key, text in enumerate(texts):
        bounds = [0, *(m.end() for m in re.finditer(r"\n|(?<=[.!?])[ \t]+", text))]
        bounds += [len(text)] if bounds[-1] != len(text) or len(bounds) == 1 else []
        sections = list(zip(bounds, bounds[1:]))
        behind = [len(text[: i + 1].encode()) for i in range(len(text))]
        counts, crossing = [0] * len(sections), [0] * len(sections)
        at, before = 0, 0
        for token in encoding.encode_ordinary(text):
            at += len(encoding.decode_single_token_bytes(token))
            end = sum(b <= at for b in behind)
            shares = [max(0, min(end, y) - max(before, x)) for x, y in sections]
            met = [n for n, share in enumerate(shares) if share] or [next(n for n, (x, y) in enumerate(sections) if x <= before < y)]
            owner = met[0] if rule == "first" else met[-1] if rule == "last" else max(met, key=lambda n: (shares[n], -n))
            counts[owner] += 1
            crossing[owner] += len(met) > 1
            before = end
        assert got[key] == [(x, y - x, c, o) for (x, y), c, o in zip(sections, counts, crossing)], text


def test_query_checksums(spark):
    from tallywarden.llm import queries

    t = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op8_binary(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for d in docs:
        ids = np.array(t.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = queries.op5_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {d.doc_id: np.array(t.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4") for d in docs}
    for r in pieces:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.length, r.ids_crc32) == (len(texts[r.doc_id]), len(ids), zlib.crc32(ids.tobytes()))
    assert sum(r.length for r in pieces) == sum(map(len, texts.values()))
