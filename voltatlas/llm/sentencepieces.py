"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is written with the mark U+2581 in front and for every space, and cut into marked words
before the first mark of each run of marks. No piece of the model crosses such a cut, so the best
segmentation of a text is that of its words one after the other; if one does, texts are not cut.

The distinct words of a batch are sorted, which lists the paths of a trie depth-first: a word
shares the leading characters of the word before it up to their common prefix. The forward scores
(best sum of piece scores up to each character, the start of its last piece, and the partial
matches that reach it) are kept on a stack; a word only computes those beyond the prefix.

Pieces and scores are those of a model file that is read and never trained. The segmentation is
the one with the highest sum of scores. For a model of merges, whose scores are ranks, this is the
Viterbi segmentation over the same pieces and not the library's order of merges. Characters
outside the vocabulary become the bytes of their UTF-8 form, so decoding restores every text that
does not hold the mark itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, with_row

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # a parameter; never copied
UNKNOWN_PENALTY = 10.0  # below the worst piece, for a character without a piece
BATCH_BYTES = 4 << 20  # texts whose distinct words share one trie; a longer text stands alone


class Pieces:
    """The vocabulary of a model as a trie, with bytes for everything else."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = [0] * 256
        self.trie: dict = {}
        self.crossing = False  # whether a piece has a mark after another character
        forms, scores, n_bytes = [], [], 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            form = b""
            if sp.is_byte(i):
                form = bytes([int(piece[3:5], 16)])
                self.byte_ids[form[0]] = i
                n_bytes += 1
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                form = piece.replace(MARK, " ").encode()
                self.crossing |= MARK in piece.lstrip(MARK)
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (sp.get_score(i), i)
                scores.append(sp.get_score(i))
            forms.append(form)
        if n_bytes != 256:
            raise ValueError("the model has no pieces for single bytes")
        self.forms = pa.array(forms, pa.large_binary())  # what a piece stands for
        self.unknown = min(scores) - UNKNOWN_PENALTY

    def encode_sorted(self, words: Sequence[str]) -> list[list[int]]:
        """Best segmentation of each of the sorted distinct marked ``words``."""
        trie, unknown = self.trie, self.unknown
        score, back, piece = [0.0], [0], [-1]  # by end position
        active: list[list] = [[(0, trie)]]  # by position: starts and trie nodes that reach it
        out, before = [], ""
        for word in words:
            n, top = len(word), min(len(word), len(before))
            shared = 0
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1:], back[shared + 1:], piece[shared + 1:], active[shared + 1:]
            for at in range(shared, n):
                c = word[at]
                best, start, which = score[at] + unknown, at, -1
                reach = []
                for begin, node in active[at]:
                    child = node.get(c)
                    if child is not None:
                        reach.append((begin, child))
                        own = child.get("")
                        # Ties go to the piece that begins first, the longest one.
                        if own is not None and (
                                score[begin] + own[0] > best
                                or (which < 0 and score[begin] + own[0] == best)):
                            best, start, which = score[begin] + own[0], begin, own[1]
                reach.append((at + 1, trie))
                score.append(best)
                back.append(start)
                piece.append(which)
                active.append(reach)
            ids, end = [], n
            while end:
                if piece[end] >= 0:
                    ids.append(piece[end])
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(word[back[end]:end].encode()))
                end = back[end]
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and the bounds of each text's."""
        texts = texts.fill_null("").cast(pa.large_string())
        # A space before every mark of a space, then none between two marks.
        front, nothing = (pa.scalar(x, pa.large_string()) for x in (MARK, ""))
        marked = pc.binary_join_element_wise(front, texts, nothing)
        marked = pc.replace_substring(marked, " ", " " + MARK)
        for _ in range(2):
            marked = pc.replace_substring(marked, MARK + " " + MARK, MARK + MARK)
        if self.crossing:
            marked = pc.replace_substring(marked, " ", "")
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        order = sorted(range(len(distinct)), key=distinct.__getitem__)
        found = self.encode_sorted([distinct[i] for i in order])
        sizes = np.zeros(len(distinct), np.int64)
        sizes[order] = [len(x) for x in found]
        place = np.empty(len(distinct), np.int64)
        place[order] = np.concatenate(([0], np.cumsum(sizes[order])))[:-1] if len(order) else 0
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        words = coded.indices.to_numpy()
        # An empty text has no pieces, though splitting it gives the mark in front as one word.
        empty = np.repeat(pc.binary_length(texts).to_numpy() == 0, _sizes(parts))
        counts = np.where(empty, 0, sizes[words])
        ends = np.cumsum(counts)
        ids = flat[np.arange(int(counts.sum())) + np.repeat(place[words] - (ends - counts), counts)]
        per_text = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(_sizes(parts))))]
        return ids, per_text

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each text: what its pieces stand for, without the mark in front."""
        joined = self.forms.take(pa.array(ids))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1)
        edges = ends[bounds]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[:edges[-1]]
        # Without the first byte of each text that has one: the space of the mark in front.
        kept = np.ones(len(data), dtype=bool)
        kept[edges[:-1][np.diff(edges) > 0]] = False
        edges = edges - np.concatenate(([0], np.cumsum(np.diff(edges) > 0)))
        return pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data[kept])])


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``BATCH_BYTES`` of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode(
    docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), model_file: str = MODEL,
    decoded: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of carried columns), ``piece_ids``, ``round_trip``.

    ``piece_ids`` is the best segmentation of the whole text; with ``decoded``, a column of that name
    has the text restored from it. ``round_trip`` tells whether that is the text. NULL and empty texts
    have no pieces and decode to the empty text. Very long texts and words take memory in proportion
    to their length. Repeated rows are encoded alike, ties between segmentations go to the longer last
    piece. Carried names stay inside the struct.
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model.value)
        for whole in batches:
            for batch in _batches(whole, "text"):
                texts = batch.column("text")
                ids, bounds = own.encode(texts)
                restored = own.decode(ids, bounds)
                same = pc.equal(restored, texts.fill_null("").cast(pa.large_binary()))
                lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids)).cast(pa.list_(pa.int32()))
                columns = {"row": batch.column("row"), "piece_ids": lists, "round_trip": same}
                if decoded:
                    columns["decoded"] = restored.cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    more = {"decoded": T.StringType()} if decoded else {}
    return docs.select(row_struct(docs, carry), docs[text_col].alias("text")).mapInArrow(
        run, with_row(docs, carry, piece_ids=T.ArrayType(T.IntegerType()), round_trip=T.BooleanType(), **more))
