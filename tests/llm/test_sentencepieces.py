import random

import pyarrow as pa
import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def pieces():
    with open(sp.MODEL, "rb") as f:
        return sp._pieces(f.read())


def vocabulary(pieces):
    out = {}

    def walk(node, prefix):
        for c, child in node.items():
            if c == "":
                out[prefix] = child
            else:
                walk(child, prefix + c)

    walk(pieces.trie, "")
    return out


def brute(pieces, known, text):
    """Viterbi over the whole marked text with every substring looked up."""
    if not text:
        return 0.0, []
    marked = sp.MARK + text.replace(" ", sp.MARK)
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        score, ids = best[end - 1]
        option = (score + pieces.unknown, ids + [pieces.byte_ids[b] for b in marked[end - 1].encode()])
        for start in range(max(0, end - 16), end):
            own = known.get(marked[start:end])
            if own and best[start][0] + own[0] > option[0]:
                option = (best[start][0] + own[0], best[start][1] + [own[1]])
        best.append(option)
    return best[-1]


def test_segmentation_is_the_best_of_the_whole_text(pieces):
    known = vocabulary(pieces)
    rng = random.Random(2)
    parts = ["the", "ing", " ", "  ", "é", "日", "🎉", "\n", "\t", "trans", "form", "er", "x", "1234", "ß", "Straße", ".", ",\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 18))) for _ in range(300)]
    ids, bounds = pieces.encode(pa.array(texts))
    score_of = {i: s for s, i in known.values()}
    for k, text in enumerate(texts):
        own = ids[bounds[k]:bounds[k + 1]].tolist()
        score, best = brute(pieces, known, text)
        if own != best:  # equal scores may be cut in several ways
            assert sum(score_of.get(i, 0.0) for i in own) == sum(score_of.get(i, 0.0) for i in best), text
            assert sum(i not in score_of for i in own) == sum(i not in score_of for i in best)


def model_vocabulary():
    """The pieces of the model file, not those of the trie."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    return {own.id_to_piece(i): (own.get_score(i), i) for i in range(own.get_piece_size())
            if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))}


def test_runs_of_spaces_take_their_pieces(pieces):
    known = model_vocabulary()
    assert vocabulary(pieces) == known and not pieces.crossing
    rng = random.Random(12)
    parts = ["def", "x", "=", "\n", "\t", " ", "  ", "   ", " " * 4, " " * 8, " " * 16, " " * 17, "return", "é", "▁", "\x00"]
    texts = [" " * n for n in range(1, 40)] + [" " * n + "if x:" for n in range(20)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    ids, bounds = pieces.encode(pa.array(texts))
    score_of = {i: s for s, i in known.values()}
    for k, text in enumerate(texts):
        own = ids[bounds[k]:bounds[k + 1]].tolist()
        score, best = brute(pieces, known, text)
        if own != best:  # equal scores may be cut in several ways
            assert sum(score_of.get(i, 0.0) for i in own) == sum(score_of.get(i, 0.0) for i in best), text
            assert sum(i not in score_of for i in own) == sum(i not in score_of for i in best), text
    assert len(pieces.encode(pa.array([" " * 15]))[0]) == 1
    restored = pieces.decode(ids, bounds).to_pylist()
    assert all(r.decode() == t for r, t in zip(restored, texts, strict=True) if sp.MARK not in t)


def test_texts_are_cut_nowhere_if_a_piece_crosses(pieces, monkeypatch):
    texts = pa.array(["a b  c", "", " ", "the river the river"])
    cut = pieces.encode(texts)
    monkeypatch.setattr(pieces, "crossing", True)
    whole = pieces.encode(texts)
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]


def test_shared_prefixes_change_nothing(pieces):
    words = sorted({sp.MARK + w for w in "a ab abc abcd abd b ba transform transformer transformed trans é éa".split()})
    together = pieces.encode_sorted(words)
    assert together == [pieces.encode_sorted([w])[0] for w in words]


def test_round_trip(spark, pieces):
    rows = awkward_rows()
    docs = awkward(spark)
    got = sp.encode(docs, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.row.text or "") and r.round_trip
        assert bool(r.piece_ids) == bool(r.row.text)
    assert sp.encode(empty(spark)).count() == 0
    marked = spark.createDataFrame([(1, "a\u2581b")], "doc_id long, text string")
    assert [r.round_trip for r in sp.encode(marked, decoded=False).collect()] == [False]


def test_batches_agree(pieces, monkeypatch):
    texts = [t for _, t, *_ in awkward_rows()]
    whole = pieces.encode(pa.array(texts))
    monkeypatch.setattr(sp, "BATCH_BYTES", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [pieces.encode(b.column("text")) for b in sp._batches(batch, "text")]
    assert len(parts) > 10
    assert [i for ids, _ in parts for i in ids.tolist()] == whole[0].tolist()
