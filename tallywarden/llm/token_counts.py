"""Token counts per section: whole documents are encoded once, token spans are joined to sections."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.shared import strings, text_steps

#: To whom a token belongs that spans several sections.
RULES = ("first", "last", "most")
#: What ends a section: a line feed; or also the white space behind a sentence.
LINE, SENTENCE = r"\n", r"\n|(?<=[.!?])[ \t]+"


class ByteTokens:
    """A byte-level vocabulary of ranks: ids of a text, and the bytes that each id stands for."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(b) for b in ranks]

    def ends(self, text: str) -> np.ndarray:
        """Byte at which each token of the text ends: the ids' bytes are the text's bytes, in order."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


_loaded: dict[tuple[str, str], ByteTokens] = {}


def byte_tokens(path: str, pattern: str) -> ByteTokens:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteTokens(path, pattern)
    return _loaded[path, pattern]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach beyond it. Spans tile the same text.

    ``section_ends`` ascend and end with the text's end; empty sections get nothing. A token that lies in one
    section is its. Of the sections that a token spans ``first`` takes the one with its first
    character, ``last`` that with its last, ``most`` that with most of it, the earlier one in a tie.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.maximum(np.searchsorted(section_ends, token_ends, side="left"), first)
    owner = last if rule == "last" else first
    crossing = np.flatnonzero(first < last)
    if rule == "most":
        two = crossing[last[crossing] == first[crossing] + 1]
        edge = section_ends[first[two]]
        owner = owner.copy()
        owner[two] += edge - starts[two] < token_ends[two] - edge
        for t in crossing[last[crossing] > first[crossing] + 1].tolist():
            edges = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [token_ends[t]]])
            owner[t] = first[t] + np.diff(edges).argmax()
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count(docs: DataFrame, vocabulary: str, pattern: str, fields: list[str] | None = None, separator: str = "\n", section_end: str = LINE, rule: str = "most") -> DataFrame:
    """Rows doc_id, section, field, start, length, n_tokens, n_crossing: every section of every document.

    With ``fields`` a document is these columns joined by ``separator`` and each column is a
    section, which the separator behind it belongs to. Without, the column text is the document and its sections end
    behind each match of ``section_end``. Either way the whole document is encoded once, as it is for
    training, and its tokens' character spans are joined to the sections' spans: both ascend, so one
    search per bound does it, in linear space. start and length count code points and tile the document.

    A token goes to one section by ``rule`` (see ``attribute``), so the sections' n_tokens add up to the
    document's. Tokens that hold a part of a character count with that character: a span begins with its first
    byte's character. n_crossing are those of a section's tokens that span others too. A null document
    or field is empty; an empty document is one section without tokens. Sections count from 0.
    Repeated rows and null doc_ids are documents of their own. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = fields or ["text"]
    kind = "doc_id long, section long, field string, start long, length long, n_tokens long, n_crossing long"
    columns = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(vocabulary, pattern)
        cut = re.compile(section_end.encode())
        for batch in batches:
            for step in text_steps(batch, "f0"):
                parts = [strings(step.column(f"f{k}")).to_pylist() for k in range(len(names))]
                out: list[list[np.ndarray]] = [[] for _ in columns[1:]]
                sizes = []
                for row in zip(*parts):
                    text = separator.join(row)
                    data = text.encode()
                    if fields:
                        ends = np.cumsum([len(x.encode()) + len(separator.encode()) for x in row])
                        ends[-1] = len(data)
                    else:
                        ends = np.array([m.end() for m in cut.finditer(data)], np.int64)
                        if not len(ends) or ends[-1] != len(data):
                            ends = np.append(ends, len(data))
                    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
                    points = np.concatenate([[0], points])
                    # In characters: a token ends after the character that its last byte belongs to, if that is complete.
                    token_ends = tokens.ends(text)
                    complete = np.concatenate([(np.frombuffer(data, np.uint8) & 0xC0) != 0x80, [True]])[token_ends] if len(token_ends) else np.zeros(0, bool)
                    token_ends = points[token_ends] - ~complete
                    section_ends = points[ends]
                    own, crossing = attribute(token_ends, section_ends, rule) if len(token_ends) else np.zeros((2, len(ends)), np.int64)
                    starts = np.concatenate([[0], section_ends[:-1]])
                    for held, values in zip(out, (np.arange(len(ends)), np.arange(len(ends)), starts, section_ends - starts, own, crossing)):
                        held.append(values)
                    sizes.append(len(ends))
                numbers = [np.concatenate(x) for x in out]
                labels = pa.array(names).take(pa.array(numbers[1] if fields else np.zeros(len(numbers[1]), np.int64)))
                ids = step.column("doc_id").take(pa.array(np.repeat(np.arange(step.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[0]), labels, *[pa.array(x.astype(np.int64)) for x in numbers[2:]]], columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(names)])
    return rows.mapInArrow(run, kind)
