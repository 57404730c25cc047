"""Token counts of sections, from one encoding of the whole document.

A document is encoded once with a byte-level vocabulary. The bytes that a token stands for give
its span of characters in the text; spans and sections are two sorted lists of intervals, joined
by binary search. A token goes to one section: that of its first character, of its last one, or
the one that holds most of its characters (``RULES``). So the counts of all sections and of the
text outside them add up to the document's tokens, which separate encodings would not.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, with_row

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a parameter; never copied
# Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Runs of what the pattern calls whitespace that are too long for its lookahead, which keeps a
# place in memory for every character of a run.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
# "first": section of a token's first character; "last": of its last character; "most": the
# section with most of its characters, the earlier one on a tie.
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(encoding, text: str) -> list[int]:
    """Ids of a whole text. The pattern's result for a long run of whitespace is known, so it is cut
    out: all but the last character before other text, all of it at the end of the text."""
    ids, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at:m.start()])
        ids += encoding._encode_single_piece(text[m.start():end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_spans(encoding, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) character of each token; a split character counts for both."""
    ids = np.array(encode(encoding, text), dtype=np.int64)
    ends = np.cumsum(sizes[ids]) if len(ids) else ids
    if len(text) == (ends[-1] if len(ids) else 0):  # one byte for each character
        return ends - sizes[ids], ends
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections; a line's end belongs to it. The empty text is one empty line."""
    breaks = []
    at = text.find("\n")
    while at >= 0:
        breaks.append(at + 1)
        at = text.find("\n", at + 1)
    edges = np.array([0, *breaks, len(text)], dtype=np.int64)
    if len(edges) > 2 and edges[-1] == edges[-2]:
        edges = edges[:-1]
    return edges[:-1], edges[1:]


def attribute(
    first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str,
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: outside all), and whether it crosses a section's edge.

    Sections are sorted and disjoint; tokens are sorted.
    """
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), dtype=bool)

    def holder(at):
        k = np.searchsorted(starts, at, side="right") - 1
        return np.where((k >= 0) & (at < ends[np.maximum(k, 0)]), k, -1)

    a, b = holder(first), holder(end - 1)
    edges = np.unique(np.concatenate((starts, ends)))
    crosses = np.searchsorted(edges, first, side="right") < np.searchsorted(edges, end, side="left")
    if rule == "first":
        return a, crosses
    if rule == "last":
        return b, crosses
    out = a.copy()
    for t in np.flatnonzero(crosses):
        lo = np.searchsorted(ends, first[t], side="right")
        hi = np.searchsorted(starts, end[t], side="left")
        shares = np.minimum(ends[lo:hi], end[t]) - np.maximum(starts[lo:hi], first[t])
        outside = (end[t] - first[t]) - shares.sum()
        k = int(np.argmax(shares)) if len(shares) else 0
        out[t] = lo + k if len(shares) and shares[k] >= max(outside, 1) else -1
    return out, crosses


def _disjoint(sections: Sequence[dict], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Given intervals in order of start, cut to the text and to the end of the one before."""
    edges, at = [], 0
    for s in sorted(((s["start"] or 0, s["end"] or 0) for s in sections if s), key=lambda x: x):
        start = min(max(s[0], at), size)
        end = min(max(s[1], start), size)
        edges.append((start, end))
        at = end
    both = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def count_tokens(
    docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",),
    sections_col: str | None = None, rule: str = "most", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``row`` (struct of carried columns), ``section, start, end, n_tokens, n_crossing``.

    One row for each section, numbered from 0 in order of start: the lines of the text, or the
    intervals of the array column ``sections_col`` (``start, end`` in characters; cut to the text,
    and where they overlap to the end of the one before; NULL: none). Tokens outside all sections
    make one row more with section -1, if there are any. ``n_crossing`` are those of a section's
    tokens that cross an edge. A NULL text is empty: one empty line without tokens. Repeated rows
    give repeated results. Long texts take memory in proportion to their length.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        known = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(known.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                given = batch.column("sections").to_pylist() if sections_col else None
                take, columns = [], [[], [], [], [], []]
                for k, text in enumerate(batch.column("text").to_pylist()):
                    text = text or ""
                    first, end = token_spans(encoding, sizes, text)
                    starts, ends = _disjoint(given[k] or [], len(text)) if sections_col else line_sections(text)
                    owner, crosses = attribute(first, end, starts, ends, rule)
                    n = np.bincount(owner + 1, minlength=len(starts) + 1)
                    over = np.bincount(owner + 1, weights=crosses, minlength=len(starts) + 1)
                    low = 0 if n[0] else 1
                    number = np.arange(-1, len(starts))[low:]
                    take.append(np.full(len(number), k))
                    for column, values in zip(columns, (
                            number, np.concatenate(([0], starts))[low:],
                            np.concatenate(([len(text)], ends))[low:], n[low:], over[low:]), strict=True):
                        column.append(values)
                merged = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(np.concatenate(take))), *merged],
                    names=["row", "section", "start", "end", "n_tokens", "n_crossing"])

    columns = [row_struct(docs, carry), docs[text_col].alias("text")]
    if sections_col:
        columns.append(F.col(sections_col).alias("sections"))
    return docs.select(*columns).mapInArrow(
        run, with_row(docs, carry, **{c: T.LongType() for c in (
            "section", "start", "end", "n_tokens", "n_crossing")}))
