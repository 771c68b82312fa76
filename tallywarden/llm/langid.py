"""Language proportions of every document: a mixture of n-gram models, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.llm.shared import lone_steps, stored, strings

#: Bytes of an n-gram and hash buckets of a model.
GRAM, BUCKETS = 4, 1 << 14
#: Added to every count.
SMOOTH = 0.5
#: Steps of expectation-maximisation for the whole set, and after each language that is left out.
STEPS, MORE_STEPS = 12, 4
#: Languages that a model may hold: with them it takes 64 MB.
MOST_LANGUAGES = 1000
#: Bytes of text whose n-grams are held at once: an n-gram takes some 30 bytes of arrays.
STEP = 250_000
#: Noise must explain a text so many times better than its languages, and than the letters of all texts, before it counts as noise.
NOISE_ODDS = 20
#: A text with fewer letters is no noise, and neither are letters of a script that all texts together have fewer of.
JUDGED, KNOWN_SCRIPT = 150, 10_000
#: Letters are uneven if their statistic lies so many deviations above what letters drawn evenly give.
UNEVEN = 4
#: A letter belongs to its script's alphabet from this share of the script's letters on.
COMMON_LETTER = 1 / 2000
#: Numbers of a step's table of n-grams and languages: with many languages steps are shorter.
STEP_NUMBERS = 16_000_000
#: What a text without any letter is.
NONE = "und"


@dataclass(frozen=True)
class Model:
    """Per language (ascending) the probability of each bucket."""

    languages: list[str]
    chances: np.ndarray


@dataclass(frozen=True)
class Letters:
    """How all texts use the letters of their scripts: code points, ascending, and each one's log share of its script
    above an even share for all letters of the script's alphabet; 0 in scripts with too few letters to tell."""

    points: np.ndarray
    gains: np.ndarray


def _normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lower-cased texts, whatever stands between letters as one space, and where each ends."""
    plain = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), r"[^\pL\pM]+", " ")
    edge, nothing = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    plain = strings(pc.binary_join_element_wise(edge, plain, edge, nothing))
    offsets = np.frombuffer(plain.buffers()[1], np.int64, len(plain) + 1)
    data = np.frombuffer(plain.buffers()[2], np.uint8, offsets[-1]) if len(plain) else np.zeros(0, np.uint8)
    return data, offsets


def _codes(data: np.ndarray) -> np.ndarray:
    codes = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        codes = (codes << np.uint32(8)) | data[k : k + len(codes)]
    return codes


def _hashed(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def grams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every normalised text, and the text's number."""
    data, offsets = _normal(texts)
    codes = _codes(data)
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    inside = np.ones(len(codes), bool)
    for k in range(1, GRAM):  # n-grams that begin in one text and end in the next
        at = offsets[1:-1] - k
        inside[at[at >= 0]] = False
    return _hashed(codes[inside], buckets), np.repeat(np.arange(len(texts)), counts)


def gram_counts(texts: pa.Array, buckets: int = BUCKETS, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of every text, the text's number and how often: ``step`` n-grams of a long text at a time."""
    if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > step:
        data, _ = _normal(texts)
        times = np.zeros(buckets, np.int64)
        for a in range(0, len(data) - GRAM + 1, step):
            times += np.bincount(_hashed(_codes(data[a : a + step + GRAM - 1]), buckets), minlength=buckets)
        found = np.flatnonzero(times)
        return found, np.zeros(len(found), np.int64), times[found]
    found, owner = grams(texts, buckets)
    keys, times = np.unique(owner * buckets + found, return_counts=True)
    return keys % buckets, keys // buckets, times


def script(points: np.ndarray) -> np.ndarray:
    """A number for the script of each letter: all Latin letters up to U+024F, all from U+2E80 on (East Asian), else blocks of 128."""
    return np.where(points < 0x250, 0, np.where(points >= 0x2E80, 1, points >> 7))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all lower-cased texts: code points and text numbers of each distinct pair, and how often."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    keys, times = np.unique(owner << 21 | points, return_counts=True)
    points = keys & ((1 << 21) - 1)
    known = np.unique(points)
    letters = np.array([chr(x).isalpha() for x in known.tolist()], bool)
    real = letters[np.searchsorted(known, points)] if len(known) else np.zeros(0, bool)
    return points[real], keys[real] >> 21, times[real]


def learn_letters(docs: DataFrame, text: str = "text") -> Letters:
    """Count the letters of all texts, labelled or not. One row per letter is gathered, at most those that Unicode has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for step in lone_steps(batch, "text", STEP):
                whole = "".join(step.column("text").to_pylist())
                for a in range(0, len(whole), STEP):
                    points, _, times = _points([whole[a : a + STEP]])
                    total[points] += times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["point", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy("point").collect()
    points, times = (np.array([r[c] for r in found], np.int64) for c in ("point", "n"))
    gains, scripts = np.zeros(len(points)), script(points)
    for one in np.unique(scripts).tolist():
        own = scripts == one
        many = times[own].sum()
        if many >= KNOWN_SCRIPT:
            alphabet = max(1, np.count_nonzero(times[own] >= COMMON_LETTER * many))
            gains[own] = np.log((times[own] + SMOOTH) / (many + SMOOTH * own.sum())) + np.log(alphabet)
    return Letters(points, gains)


def letter_gains(texts: list[str], letters: Letters) -> np.ndarray:
    """How much better than letters drawn evenly a text's letters are explained; 0 where it has too few to judge.

    By the letters of all texts, or, where these do no better, by the text itself: if its own letters are
    so uneven that chance does not give it (the likelihood ratio against an even share of each, about chi-square
    with a degree of freedom less than there are letters), the gain is how far. Any real language's are in a text of 150 letters.
    """
    counts: list[dict[int, int]] = [{} for _ in texts]
    judged, gains = np.zeros(len(texts)), np.zeros(len(texts))
    whole = sum(map(len, texts))
    for some in [range(len(texts))] if whole <= STEP else [[i] for i in range(len(texts))]:
        most = max((len(texts[i]) for i in some), default=0)
        for a in range(0, most, STEP):
            points, owner, times = _points([texts[i][a : a + STEP] for i in some])
            at = np.searchsorted(letters.points, points)
            known = at < len(letters.points)
            known[known] = letters.points[at[known]] == points[known]
            each = np.zeros(len(points))
            each[known] = letters.gains[at[known]]
            np.add.at(judged, np.asarray(some)[owner], times * (each != 0))
            np.add.at(gains, np.asarray(some)[owner], times * each)
            for i, point, n in zip(np.asarray(some)[owner].tolist(), points.tolist(), times.tolist()):
                counts[i][point] = counts[i].get(point, 0) + n
    for i, own in enumerate(counts):
        n, kinds = np.array(list(own.values()), float), len(own)
        if gains[i] < 0 and kinds > 1:
            ratio = 2 * (n * np.log(n * kinds / n.sum())).sum()
            gains[i] = max(gains[i], ratio - (kinds - 1) - UNEVEN * np.sqrt(2 * (kinds - 1)))
    return np.where(judged >= JUDGED, gains, 0.0)


def learn(docs: DataFrame, label: str = "lang", text: str = "text", buckets: int = BUCKETS) -> Model:
    """Count the n-grams of all rows with a label; a task sends one row per language and bucket it met.

    The model, one number per language and bucket, is gathered: at most 1000 languages, else an
    error. Rows without label or text teach nothing; without any labelled row the model is empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for step in lone_steps(batch, "text", STEP):
                labels = step.column("label").dictionary_encode()
                names, codes = labels.dictionary.to_pylist(), labels.indices.to_numpy()
                found, owner, times = gram_counts(step.column("text"), buckets)
                sums = np.bincount(codes[owner] * buckets + found, weights=times, minlength=len(names) * buckets).astype(np.int64).reshape(len(names), buckets)
                for name, row in zip(names, sums):
                    totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["label", "bucket", "n"])

    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    sums = stored(sums, "grams")
    names = sorted(r.label for r in sums.select("label").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")

    def packed(rows: pa.Table) -> pa.Table:
        row = np.zeros(buckets, np.int64)
        row[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"label": rows["label"][:1], "counts": pa.array([row.tobytes()], pa.binary())})

    # A group has one row per bucket, and one language's row of counts is one value on the way to the driver.
    found = sums.groupBy("label").applyInArrow(packed, "label string, counts binary").collect()
    counts = np.full((len(names), buckets), SMOOTH, np.float32)
    for r in found:
        counts[names.index(r.label)] += np.frombuffer(r.counts, np.int64)
    return Model(names, counts / counts.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32) if names else counts)


def mixtures(found: np.ndarray, owner: np.ndarray, count: int, chances: np.ndarray, penalty: float = 1.0, fits: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions (texts x languages); 0 where a language is not in the text's chosen set.

    Expectation-maximisation over all languages, then the language with the least share is left out,
    again and again; of all these sets the one with the greatest log likelihood less
    ``penalty`` x (languages - 1) x log(n-grams) / 2 is chosen, the smaller one in a tie. Its log likelihood is put into ``fits``, if given.
    With ``times`` each pair of bucket and text is there once and says how often.
    """
    many, buckets = chances.shape
    if times is None:
        keys, times = np.unique(owner * buckets + found, return_counts=True)
        owner, found = keys // buckets, keys % buckets
    text, times = owner, times.astype(np.float32)
    likely = chances[:, found]
    total = np.bincount(text, weights=times, minlength=count)
    share = np.full((count, many), 1 / many)

    def climb(share: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            own = share.astype(np.float32)[text]
            ratio = times / np.maximum(np.einsum("gl,lg->g", own, likely), 1e-30)
            gained = np.stack([np.bincount(text, weights=ratio * likely[k], minlength=count) for k in range(many)], axis=1)
            share = share * gained / np.maximum(total, 1)[:, None]
        return share

    def worth(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = share.astype(np.float32)[text]
        fit = np.bincount(text, weights=times * np.log(np.maximum(np.einsum("gl,lg->g", own, likely), 1e-30)), minlength=count)
        return fit, fit - penalty * (np.count_nonzero(share, axis=1) - 1) * np.log(np.maximum(total, 1)) / 2

    share = climb(share, STEPS)
    best, (fit, value) = share.copy(), worth(share)
    for _ in range(many - 1):
        least = np.where(share > 0, share, np.inf).argmin(axis=1)
        share[np.arange(count), least] = 0
        left = share.sum(axis=1, keepdims=True)
        share = climb(np.divide(share, left, out=np.zeros_like(share), where=left > 0), MORE_STEPS)
        now_fit, now = worth(share)
        better = now >= value
        best[better], value[better], fit[better] = share[better], now[better], now_fit[better]
    if fits is not None:
        fits[:] = fit
    return best / np.maximum(best.sum(axis=1, keepdims=True), 1e-30)


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 1.0, gain: str | None = None, letters: Letters | None = None) -> DataFrame:
    """Every row and column of ``docs`` with ``lang_pred``, ``score`` and ``languages``.

    languages holds the chosen set, the largest share first, each with its share of the text;
    lang_pred is the first of them and score its share. A text that is null or holds no letter is
    ``und`` with score 0 and no languages, and so is every text under a model without languages.
    Ties go to the language that sorts first. Only the text is read for it; columns of these three names are replaced.

    With ``gain`` a column of that name holds how much better the mixture explains the text's n-grams than
    noise does, which takes all buckets alike: the difference of the log likelihoods, 0 for ``und``. With ``letters`` it
    is at least the gain that these give over letters drawn evenly, which needs no label of the text's language
    and is 0 where nothing can be said: few letters, or a script that is rare in all texts.

    Steps of some 250 kB (less with many languages) are held as arrays; of a longer text only the counts of its n-grams.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
    if gain:
        added = added.add(gain, T.DoubleType())
    rows = docs.drop(*added.names)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.chances, letters))
    limit = min(STEP, max(1, STEP_NUMBERS // max(1, len(model.languages))))

    def guess(texts: pa.Array) -> list[pa.Array]:
        names, chances, letters = shared.value
        lettered = pc.match_substring_regex(strings(texts), r"\pL").to_numpy(zero_copy_only=False)
        shares, gains = np.zeros((len(texts), len(names))), np.zeros(len(texts))
        at = np.flatnonzero(lettered)
        if len(at) and names:
            found, owner, times = gram_counts(strings(texts.take(pa.array(at))), chances.shape[1])
            fits = np.zeros(len(at))
            shares[at] = mixtures(found, owner, len(at), chances, penalty, fits, times)
            gains[at] = fits + np.bincount(owner, weights=times, minlength=len(at)) * np.log(chances.shape[1])
            doubt = at[gains[at] <= 0]
            if gain and letters is not None and len(doubt):
                gains[doubt] = np.maximum(gains[doubt], letter_gains(texts.take(pa.array(doubt)).to_pylist(), letters))
        first = shares.argmax(axis=1) if names else np.zeros(len(texts), int)
        known = lettered & (shares.sum(axis=1) > 0)
        best = [names[k] if ok else NONE for k, ok in zip(first.tolist(), known)]
        score = [float(min(1.0, s[k])) if ok else 0.0 for s, k, ok in zip(shares, first, known)]
        sets = [[{"lang": names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] if ok else [] for s, ok in zip(shares, known)]
        out = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
        return [*out, pa.array(gains)] if gain else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in lone_steps(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*step.columns, *guess(step.column(text))], [*step.schema.names, *added.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def held_out(doc_id: Column) -> Column:
    """Rows kept back from learning: crc32 of the id as text leaves 2 modulo 4; no id: never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
