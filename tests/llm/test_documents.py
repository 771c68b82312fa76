"""Mixing, line dedup, near-duplicates, language ID and the pipeline against SQL or brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywarden.llm import langid, linededup, mixing, neardup, shared, sql
from tallywarden.llm.shared import components
from tests.llm.conftest import SCHEMA, prose

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(got, want):
    """Do a DataFrame and a DuckDB relation hold the same rows?"""
    return Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(200)] + [(7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixing


def test_mix_equals_sql(odd, duck):
    assert same(mixing.schedule(odd), duck(documents=odd.select("doc_id", "text", "source")).sql(sql.MIXING))


def test_targets_reach_the_budget(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 50), ("d", 10), (None, 30), ("e", 0)], "source string, size long")
    found = {r.source: r for r in mixing.targets(sizes).collect()}
    assert sum(r.target for r in found.values()) == pytest.approx(191 * 1.5)
    assert all(r.target <= 2 * r.source_size for r in found.values())
    open_level = {r.target / w for s, w in (("a", 5), ("c", 1), (None, 1)) if (r := found[s]).target < 2 * r.source_size}
    assert len(open_level) <= 1 or max(open_level) == pytest.approx(min(open_level))


def test_mix_rows(odd, none, odd_rows):
    plan = Counter()
    for r in mixing.schedule(odd).collect():
        plan[r.doc_id, r.size] += r.copies
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    rows = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in got.collect())
    assert rows == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix(none).count() == mixing.schedule(none).count() == 0


def test_hot_source_in_chunks(spark, duck, monkeypatch):
    """Small chunks and slices change nothing, and sources come near their targets."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 < 2, 'hot', concat('s', id % 7)) AS source", "repeat('w ', cast(1 + id % 9 AS int)) AS text")
    want = duck(documents=docs).sql(sql.MIXING)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    got = mixing.schedule(docs)
    assert same(got, want)
    for r in got.groupBy("source", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r.target) <= 20


# Line dedup


def test_lines_equal_sql(spark, odd, odd_rows, duck):
    rows = [r for r in odd_rows if r[0] not in (None, 1)] + [odd_rows[0]]
    long_line = prose(9, 55)
    rows += [(20 + k, "\n".join([prose(30 + k, 8), *([f"shared {i} line" for i in range(12)] * (1 + k % 2)), prose(60 + k, 7), long_line, prose(90 + k, 5)]), "en", "a", 1) for k in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = linededup.dedupe(docs)
    assert same(got, duck(documents=docs).sql(sql.LINES))
    texts = {r.doc_id: r.text for r in got.collect()}
    assert sum(long_line in (t or "") for t in texts.values()) == 1
    assert sum("shared 5 line\nshared 6 line" in (t or "") for t in texts.values()) <= 8


def stays(rows, least=50):
    """Words in later runs of lines of ``least`` words or more whose worded lines stood before, by brute force."""
    seen, count = set(), 0
    for _, text in sorted(rows):
        full = [(x, len(WORD.findall(x))) for x in (text or "").split("\n") if WORD.search(x)]
        own, hit = set(), set()
        for i in range(len(full)):
            for j in range(i, len(full)):
                if sum(n for _, n in full[i : j + 1]) >= least:
                    run = tuple(x for x, _ in full[i : j + 1])
                    if run in seen:
                        hit.update(range(i, j + 1))
                    own.add(run)
        seen |= own
        count += sum(full[k][1] for k in hit)
    return count


def test_repeated_passages_go_whole(spark):
    """Runs of short lines of over 50 words go whole, whatever stands around them; shorter ones only by chunks."""
    runs = [[prose(100 * k + i, n) for i, n in enumerate(sizes)] for k, sizes in enumerate([[9] * 7, [30, 30, 9], [3] * 20, [5, 44, 1, 1], [12] * 5])]
    rows = []
    for copy in range(6):
        for k, run in enumerate(runs):
            own = 5000 + 100 * copy + k
            rows.append((len(rows), "\n".join([prose(own, 8), *[""] * (copy % 2), *run, prose(own + 50, 6)])))
    rows.append((900, "\n".join(["again"] * 130)))
    rows.append((901, rows[0][1].replace("\n", "\n\n")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedupe(docs, passage=50).collect()}
    assert stays(rows) > 1000 and stays((k, r.text) for k, r in got.items()) == 0
    assert stays((r.doc_id, r.text) for r in linededup.dedupe(docs).collect()) > 0  # chunks alone
    for k, text in rows[:5]:
        assert got[k].text == text and got[k].lines_removed == 0
    for k, text in rows[5:30]:
        lines = text.split("\n")
        assert [x for x in got[k].text.split("\n") if x] == [lines[0], lines[-1]]
        assert len(lines) - got[k].lines_removed == len(got[k].text.split("\n"))
    assert got[901].text.strip() == ""
    assert got[900].text.count("again") >= 1


@pytest.mark.parametrize("passage", [None, 50])
def test_lines_send_nothing_on_a_guess(spark, little_sent, passage):
    """Hashes and pieces that stand twice are shuffled, though their files look small."""
    rows = [(k, "\n".join(prose(k % 70 * 20 + i, 12) for i in range(20))) for k in range(140)]
    with little_sent(0.02):
        got = {r.doc_id: r for r in linededup.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), passage=passage).collect()}
    assert all(got[k].text == text for k, text in rows[:70])
    assert all(got[k].lines_removed >= (20 if passage else 2) for k in range(70, 140))


def test_pipeline_drops_exact_copies_of_short_lines(spark):
    text = "\n".join(prose(700 + i, 6) for i in range(15))
    docs = spark.createDataFrame([(k, text, "en", "a", len(text)) for k in range(4)], SCHEMA)
    assert [(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()] == [(0, text)]


def test_lines_of_odd_rows(odd, none):
    got = linededup.dedupe(odd)
    assert got.columns == [c for c in odd.columns if c != "lines_removed"] + ["lines_removed"]
    rows = defaultdict(list)
    for r in got.collect():
        rows[r.doc_id].append((r.text, r.lines_removed))
    assert rows[1][0] == rows[1][1] and rows[1][0][1] == 0  # rows of one document keep their lines
    assert rows[7] == [("", 1)]  # a long line that stands in document 1
    assert rows[2] == [(None, 0)] and rows[3] == [("", 0)]
    assert sorted(n for _, n in rows[None]) == [0, 0]  # its line is too short to be a chunk of its own
    assert rows[10][0][1] >= 1 and prose(3, 60) not in rows[10][0][0]
    assert linededup.dedupe(none).count() == 0


# Near-duplicates


def truth(rows, percent=85):
    """Components by comparing all pairs; a row is (doc_id, text)."""
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, len(s), key if not s else least.get(find(i)), (key == least.get(find(i))) if s else True) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def near_rows(count, seed=4):
    """Chains and clusters of copies with a few words changed, around the threshold."""
    random.seed(seed)
    rows, key = [], 0
    for group in range(count):
        words = prose(group, random.randint(4, 120)).split()
        for _ in range(random.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = f"new{random.randrange(10**6)}"
            if random.random() < 0.3:
                words = copy
            rows.append((key, " ".join(copy)))
            key += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    rows = near_rows(60)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == truth(rows)


def test_near_duplicates_of_odd_rows(odd, none, odd_rows):
    got = neardup.near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == truth([r[:2] for r in odd_rows])
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())) == [1, 2, 3, 4, 5, 8, 10, 11, 12, 13]
    assert kept.where("doc_id IS NULL").count() == 2
    assert neardup.representatives(none).count() == 0


def test_representatives_lose_no_text_by_its_id(spark):
    """Unlike texts under one id both stay, of copies without id one does, rows without words all stay."""
    rows = [(7, prose(1, 50)), (7, prose(2, 50)), (7, prose(2, 50)), (None, prose(3, 50)), (None, prose(3, 50)), (None, prose(4, 50)), (9, prose(4, 50) + " x"), (None, prose(5, 60) + " y"), (None, prose(5, 60))]
    rows += [(8, prose(2, 50) + " z"), (None, ""), (None, None), (5, None), (5, " "), (6, prose(1, 50) + " w")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, first long")
    got = neardup.representatives(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    texts = [t for _, t in kept if t and t.strip()]
    assert kept[7, prose(2, 50)] == 1 and kept[6, prose(1, 50) + " w"] == 1 and kept[9, prose(4, 50) + " x"] == 1 and kept[None, prose(3, 50)] == 1
    assert len(texts) == 5 and sum(prose(5, 60) in t for t in texts) == 1
    assert [kept[k] for k in ((None, ""), (None, None), (5, None), (5, " "))] == [1, 1, 1, 1] and sum(kept.values()) == 9
    again = neardup.representatives(docs)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    linked = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert linked[None, 46] in (9, None) and linked[9, 47] == 9


def test_components_with_hubs(spark, monkeypatch):
    """A node with very many neighbours, a chain, random edges, loops and nulls: every node gets its component's smallest node."""
    monkeypatch.setattr(shared, "HUB_ROWS", 50)
    rng = np.random.default_rng(1)
    edges = [(0, i) for i in range(1, 900)] + [(int(a), int(b)) for a, b in rng.integers(10_000, 11_000, (400, 2))] + [(i, i + 1) for i in range(30_000, 30_020)] + [(7, 30_000), (5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(up))


def test_near_duplicates_send_nothing_on_a_guess(spark, little_sent, monkeypatch):
    """Sketches, shared values and groups are shuffled, though their files look small; so are names that are counted to be many."""
    monkeypatch.setattr(neardup, "FEW_MEMBERS", 0)
    rows = [(2 * k + copy, prose(k, 60) + " again" * copy) for k in range(150) for copy in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with little_sent(0.02):
        found = neardup.near_duplicates(docs).collect()
        stay = neardup.representatives(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(k, k - k % 2) for k in range(300)]
    assert sorted(r.doc_id for r in stay) == list(range(0, 300, 2))


def test_common_passage_makes_no_group(spark):
    """Half of all rows share a passage; only copies are linked, and the passage's lists cost nothing."""
    rows = [(i, prose(1, 30) + " " + prose(1000 + i, 60)) for i in range(400)] + [(1000 + i, prose(1000 + i, 60) + f" a{i} b{i}") for i in range(20)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == truth(rows)


def test_shingles_of_slices():
    texts = pa.array([None, "A b C d e f", "", "x", "a b c d e f a b c d e"] * 3)
    whole, ends = neardup.shingles(texts, 5)
    assert np.diff(ends).tolist() == [0, 2, 0, 1, 6] * 3  # the last repeats its first shingle
    for i in range(len(texts)):
        one, _ = neardup.shingles(texts.slice(i, 1), 5)
        assert one.tolist() == whole[ends[i] : ends[i + 1]].tolist()


# Language


def test_held_out_accuracy(spark):
    from tallywarden.llm import queries

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_langid(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    held = [d for d in docs if got[d.doc_id].held_out]
    assert len(got) == len(docs) and 150 < len(held) < 350
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    by = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}'").orderBy("doc_id").limit(6).collect()) for lang in ("en", "de", "fr")}
    texts = [(1, by["en"][:3000]), (2, by["en"][:2000] + " " + by["de"][:1000]), (3, by["fr"][:1500] + by["de"][:1500] + by["en"][:3000])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [x.lang for x in got[1].languages] == ["en"]
    assert [x.lang for x in got[2].languages] == ["en", "de"] and got[2].score == pytest.approx(2 / 3, abs=0.1)
    assert {x.lang for x in got[3].languages} == {"en", "de", "fr"} and got[3].lang_pred == "en"


def test_mixtures_climb_to_the_best_share():
    """With two languages the proportion must be the best one of a fine grid."""
    rng = np.random.default_rng(1)
    chances = rng.dirichlet(np.ones(64), 2)
    words = np.concatenate([rng.choice(64, 300, p=chances[0]), rng.choice(64, 100, p=chances[1])])
    share = langid.mixtures(words, np.zeros(400, int), 1, chances.astype(np.float32))[0, 0]
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.log(grid[:, None] * chances[0][words] + (1 - grid)[:, None] * chances[1][words]).sum(axis=1).argmax()]
    assert share == pytest.approx(best, abs=0.02)


def test_grams_of_slices():
    texts = pa.array(["Ab 12 cd", None, "", "é", "x y"] * 3)
    found, owner = langid.grams(texts)
    for i in range(len(texts)):
        one, _ = langid.grams(texts.slice(i, 1))
        assert one.tolist() == found[owner == i].tolist()


def test_languages_of_odd_rows(odd, none):
    model = langid.learn(odd)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c not in ("lang_pred", "score", "languages")] + ["lang_pred", "score", "languages"]
    rows = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {2, 3, 4, 12}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows.values())
    assert got.count() == odd.count() and langid.identify(none, model).count() == 0
    empty = langid.learn(none)
    assert empty.languages == [] and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert odd.select(langid.held_out(odd.doc_id).alias("x")).where("x IS NULL").count() == 0


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER).persist()
        assert docs.columns == before.columns, name
        old, new = before.collect(), docs.collect()
        ids = {r.doc_id for r in new}
        assert ids <= {r.doc_id for r in old}
        if name == "language ID":
            assert ids == {r.doc_id for r in old if re.search(r"[^\W\d_]", r.text or "")}
        if name == "MinHash near-dedup":
            want = {k for k, _, _, kept in truth([(r.doc_id, r.text) for r in old], 80) if kept}
            assert ids == want and len(new) == len(want)
        if name.startswith("mixing"):
            size = sum(len(WORD.findall(r.text)) for r in old)
            assert sum(len(WORD.findall(r.text)) for r in new) == pytest.approx(1.5 * size, rel=0.02)
            assert max(Counter(r.doc_id for r in new).values()) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())


def test_language_stage_rejects_noise_and_keeps_unlabelled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = [(10**6 + i, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(60)), None, "a", 1) for i in range(20)]
    held = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), None).otherwise(F.col("lang")))
    both = held.unionByName(spark.createDataFrame(noise, SCHEMA).select(docs.columns))
    lettered = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, both, FOLDER).collect()}
    assert got == lettered  # held-out documents stay, noise goes
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, bare, FOLDER).collect()} == lettered


UNKNOWN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä, sanoo ensimmäinen artikla.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。" * 3,
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "for (int i = 0; i < n; ++i) { std::vector<double> xs(k); std::fill(xs.begin(), xs.end(), 0.0); if (xs[i] > max) { return sqrt(xs[i]) * kQuux; } } // see the note above",
    "Jazz quiz", "ok",
]


@pytest.mark.parametrize("left", ["de", "es", "fr", "en"])
def test_language_stage_keeps_languages_without_labels(spark, left):
    """Without one language's labels its clean documents stay, so do other languages, scripts and code; random letters go."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = [(10**6 + i, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(60)), None, "a", 1) for i in range(20)]
    others = [(2 * 10**6 + i, text, None, "a", 1) for i, text in enumerate(UNKNOWN)]
    known = docs.withColumn("lang", F.when(F.col("lang") != left, F.col("lang")))
    rows = known.unionByName(spark.createDataFrame(noise + others, SCHEMA).select(docs.columns))
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, rows, FOLDER).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert got == lettered | {r[0] for r in others}


def test_long_text_is_counted_in_steps():
    text = " ".join(prose(i, 400) for i in range(20)) + " é中"
    whole = langid.grams(pa.array([text], pa.large_string()))[0]
    for step in (37, 1000):
        found, owner, times = langid.gram_counts(pa.array([text], pa.large_string()), step=step)
        assert np.array_equal(np.bincount(found, weights=times, minlength=langid.BUCKETS), np.bincount(whole, minlength=langid.BUCKETS)) and not owner.any()
    texts = pa.array([text, "", None, "abc", text[:50]], pa.large_string())
    found, owner, times = langid.gram_counts(texts)
    plain, own = langid.grams(texts)
    assert sorted(zip(np.repeat(owner, times), np.repeat(found, times))) == sorted(zip(own, plain))


def test_letters_in_steps(spark, monkeypatch):
    texts = [text * 3 for text in UNKNOWN]
    letters = langid.learn_letters(spark.createDataFrame([(t,) for t in texts * 30], "text string"))
    whole = langid.letter_gains(texts, letters)
    monkeypatch.setattr(langid, "STEP", 40)
    assert np.allclose(langid.letter_gains(texts, letters), whole)
    assert langid.learn_letters(spark.createDataFrame([], "text string")).points.size == 0


def test_chosen_set_is_the_best_of_all_sets():
    """The set that leaving out one language after another ends with, against every set of languages."""
    rng = np.random.default_rng(9)
    chances = rng.dirichlet(np.full(300, 0.2), 4).astype(np.float32)
    chances = (chances + 1e-6) / (chances + 1e-6).sum(axis=1, keepdims=True)

    def value(counts, names):
        share = np.full(len(names), 1 / len(names))
        for _ in range(300):
            mix = share @ chances[names]
            share = share * (chances[names] @ (counts / mix)) / counts.sum()
        return (counts * np.log(share @ chances[names])).sum() - (len(names) - 1) * np.log(counts.sum()) / 2

    sets = [[k for k in range(4) if m >> k & 1] for m in range(1, 16)]
    same = 0
    for n in range(40):
        share = rng.dirichlet(np.full(4, 0.3))
        words = np.concatenate([rng.choice(300, c, p=p.astype(float) / p.astype(float).sum()) for p, c in zip(chances, rng.multinomial(250, share))])
        got = langid.mixtures(words, np.zeros(len(words), int), 1, chances)[0]
        counts = np.bincount(words, minlength=300).astype(float)
        worth = [value(counts, s) for s in sets]
        own = sets.index(np.flatnonzero(got).tolist())
        assert worth[own] > max(worth) - 2
        same += own == int(np.argmax(worth))
    assert same >= 36


def test_pipeline_of_odd_rows(spark, odd, none):
    for rows in (odd, none):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == odd.columns and [f.dataType for f in docs.schema] == [f.dataType for f in odd.schema]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert (packed.count() > 0) == (rows is odd)
