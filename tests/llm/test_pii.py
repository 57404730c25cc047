import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty, prose
from voltatlas.llm import pii, tagger


def base_brute(text):
    out = [("email", *m.span()) for m in re.finditer(pii.EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(pii.IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(pii.CARD, text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(pii.PHONE, text)
            if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", "-", ".", "..", "1", "25", "256", "0001", ".1.2", "1.2.3.4", "+", "+1", "(", ") ", " ", "\n",
             "4111 1111 1111 1111", "4111-1111", "555", "é", "%", "_", "+44 20 7946 0958", "1" * 25]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert pii.base_spans(text) == base_brute(text), text


def test_long_runs_are_scanned_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000):
        pii.base_spans(text)


def data(rng, n):
    """Texts with spans, as they are written by the base patterns."""
    out = []
    for _ in range(n):
        kind = rng.choice(pii.KINDS)
        if kind == "email":
            item = "".join(rng.choice("abcdefgh") for _ in range(6)) + f".{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        elif kind == "ip":
            item = ".".join(str(rng.randrange(10, 99)) for _ in range(4))
        elif kind == "card":
            digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
            digits += next(d for d in "0123456789" if pii.luhn(digits + d))
            item = " ".join(digits[i:i + 4] for i in range(0, 16, 4))
        else:
            item = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        before = prose(rng, rng.randrange(0, 40))
        out.append((f"{before} {item} {prose(rng, 30)}", kind, len(before) + 1, len(before) + 1 + len(item), item))
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    windows = [w for text, *_ in data(rng, 900) for w in pii.labelled_windows(text)]
    return tagger.fit(*pii.training_set(windows), pii.KINDS, steps=pii.STEPS)


def grouped(rng, mark, size=4):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    digits += next(d for d in "0123456789" if pii.luhn(digits + d))
    return mark.join(digits[i:i + size] for i in range(0, 16, size))


def phone(rng, mark, start=""):
    return start + mark.join(["1", str(rng.randrange(200, 999)), "555", str(rng.randrange(1000, 9999))])


def address(rng, at, dot=".", digits=True):
    name, host = ("".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(4, 9))) for _ in range(2))
    return f"{name}{f'.{rng.randrange(99)}' if digits else ''}{at}{host}{dot}example{dot}com"


def numeric(rng, mark):
    return mark.join(str(rng.randrange(10, 99)) for _ in range(4))


FORMS = [("card", grouped, (m,)) for m in (".", "/", "_", "  ")]
FORMS += [("phone", phone, x) for x in ((" ",), ("-",), (".",), ("/",), ("-", "+ "), (" ", "+ "))]
FORMS += [("ip", numeric, (m,)) for m in ("[.]", " . ")]
FORMS += [("email", address, (at, ".", d)) for at in (" @ ", " (at) ", "(at)", "[at]", " [at] ") for d in (True, False)]
FORMS += [("email", address, (" (at) ", " (dot) ", False)), ("email", address, ("[at]", "[dot]", False))]


@pytest.mark.parametrize("kind, make, how", FORMS)
def test_every_rewritten_form_is_found(model, kind, make, how):
    """Nine of ten unseen items of each form, with their whole spans."""
    rng = random.Random(f"{kind} {how}")
    texts, places = [], []
    for _ in range(60):
        before, item = prose(rng, rng.randrange(1, 40)), make(rng, *how)
        texts.append(f"{before} {item} {prose(rng, 25)}")
        places.append((kind, len(before) + 1, len(before) + 1 + len(item)))
    base, more = pii.all_spans(model, texts)
    assert sum(p in b + m for p, b, m in zip(places, base, more, strict=True)) >= 54


def test_numbers_are_taken_whole():
    card = "4111.1111.1111.1111"
    text = f"order 105 {card} a116"
    a, b = text.index(card), text.index(card) + len(card)
    for x, y in ((a - 4, b), (a, b + 5), (a + 2, b - 3), (a, b)):
        assert pii._whole_number("card", text, x, y) == ("card", a, b)
    # A phone of sixteen digits is a card, and a phone that passes its check stays one.
    assert pii._whole_number("phone", "x 4111  1111  1111  1111 y", 2, 24) == ("card", 2, 24)
    assert pii._whole_number("phone", "x 1 212 555 0100 y", 2, 16) == ("phone", 2, 16)
    # An address keeps four groups; more of them that fit alike give the first.
    assert pii._whole_number("ip", "at 17 . 31 . 18 . 32 now", 3, 17) == ("ip", 3, 20)
    # Nothing passes: the span stays and is dropped by its check.
    assert pii._whole_number("card", "x 1234.5678.9012.3456 y", 2, 21) == ("card", 2, 21)
    # A group that goes on beyond the reach is no candidate, and long runs cost little.
    long = "1" * 5_000 + " " + "22 " * 5_000
    for x in (0, 2_000, 4_990, 9_000):
        assert pii._whole_number("card", long, x, x + 30)[1:] is not None


def test_an_address_is_cut_at_the_next_word():
    text = "see jo.9 [at] mail.example.org lamp and more"
    assert pii._whole_email(text, 4, text.index("lamp") + 4) == (4, text.index(" lamp"))
    text = "see jo [at] a [dot] bc [dot] com now"
    assert pii._whole_email(text, 5, text.index(" bc")) == (4, text.index(" now"))


def test_rewritten_emails_without_digits_are_found(model):
    rng = random.Random(41)
    hit, cases = 0, []
    for _ in range(120):
        name, host = ("".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(4, 9))) for _ in range(2))
        at, dot = rng.choice([(" (at) ", "."), ("[at]", "."), (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        cases.append((prose(rng, 20), f"{name}{at}{host}{dot}example{dot}com", prose(rng, 20)))
    for before, form, after in cases:
        base, more = pii.all_spans(model, [f"{before} {form} {after}"])
        hit += ("email", len(before) + 1, len(before) + 1 + len(form)) in base[0] + more[0]
    assert hit >= 0.75 * len(cases)


def test_every_form_that_a_check_takes_is_plausible_and_decoded():
    for text in ("jane.doe [at] example.org", "jane (at) example (dot) com", "jane @ example.org"):
        assert pii.plausible("email", text) and pii.window_starts(text) == [0]
    assert not pii.plausible("email", "jane at example.org")
    # A hint across the edge of a window is in the windows of both sides.
    assert pii.window_starts("x" * 125 + "[at]" + "y" * 300) == [0, 64, 128]


def test_nothing_is_added_to_plain_prose(model):
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(30)] + ["version 3. 12 May 2024, 10:30. Pages 3-5, 7 and 1,000,000"]
    assert all(not m for m in pii.all_spans(model, texts)[1])


def test_windows_without_a_hint_add_nothing(model):
    """Decoding every window gives the same spans in the end."""
    rng = random.Random(15)
    texts = [" ".join([prose(rng, 120), t, prose(rng, 90)]) for t, *_ in data(rng, 25)] + ["", "no digits at all " * 30]
    few = pii.all_spans(model, texts)[1]
    whole = pii.found_by_tagger
    try:
        pii.found_by_tagger = lambda m, t: whole(m, t, every=True)
        assert pii.all_spans(model, texts)[1] == few
    finally:
        pii.found_by_tagger = whole


def test_every_span_lies_whole_in_a_window():
    text = "x" * 1_000 + "1234567890" + "y" * 500
    starts = pii.window_starts(text)
    assert any(s <= 1_000 and 1_010 <= s + pii.WINDOW for s in starts)
    assert all(s % pii.STRIDE == 0 for s in starts) and len(starts) <= 4
    assert pii.window_starts("") == [] and pii.window_starts("1") == [0]


def test_reconciliation():
    # A piece cut at a window's edge joins the whole span of the next window.
    assert pii.reconcile([("phone", 100, 128, 9.0, True), ("phone", 100, 140, 20.0, False)]) == [("phone", 100, 140)]
    assert pii.reconcile([("email", 50, 64, 5.0, True), ("email", 60, 80, 6.0, True)]) == [("email", 50, 80)]
    # The best disjoint set, not the best span.
    spans = [("card", 0, 20, 5.0, False), ("ip", 0, 9, 3.0, False), ("phone", 10, 20, 3.0, False)]
    assert pii.reconcile(spans) == [("ip", 0, 9), ("phone", 10, 20)]
    assert pii.reconcile([]) == []


def test_decoding_is_the_best_path(model):
    """Viterbi against all paths of short windows."""
    import itertools

    x = np.array([tagger.codes_of("a1 @"), tagger.codes_of("+1 2")])
    lengths = np.array([4, 3])
    path, scores = model.decode(x, lengths)
    start, move = model._transitions()
    for i, n in enumerate(lengths):
        def total(p, i=i):
            return start[p[0]] + sum(scores[i, t, v] for t, v in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))

        best = max(itertools.product(range(model.labels), repeat=int(n)), key=total)
        assert tuple(path[i, :n]) == best and not path[i, n:].any()


def test_gradients():
    rng = np.random.default_rng(0)
    k, n, steps = 5, 3, 6
    start, move = tagger.allowed_transitions(k)
    scores = rng.standard_normal((n, steps, k))
    labels = np.array([[0, 1, 2, 0, 3, 4], [1, 2, 2, 0, 0, 0], [3, 4, 0, 1, 2, 0]])
    lengths = np.array([6, 4, 5])
    loss, d_scores, _, d_move = tagger.crf_gradients(scores, start, move, labels, lengths)
    for at in [(0, 0, 0), (1, 2, 2), (2, 4, 2)]:
        moved = scores.copy()
        moved[at] += 1e-6
        up = tagger.crf_gradients(moved, start, move, labels, lengths)[0]
        assert (up - loss) / 1e-6 == pytest.approx(d_scores[at], abs=1e-4)
    assert abs(d_move.sum(axis=1)).max() < 10


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert pii.train(empty(spark)) is None
    got = pii.find_personal_data(docs, None).collect()
    assert len(got) == len(awkward_rows())
    assert {r.base_sha256 for r in got if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(empty(spark), None).count() == 0
