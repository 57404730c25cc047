"""Personal data: base patterns, and a character-level BiLSTM with CRF transitions.

The tagger is trained in numpy on labelled windows: those of a bounded sample of documents, whose
base spans are the labels, with copies in which the spans are written another way (separators,
brackets, without the plus, addresses without digits), so that it learns the forms that the patterns miss. Texts are cut into
windows of ``WINDOW`` characters every ``STRIDE``; each is decoded by Viterbi. Spans of all windows
of a text are then reconciled at once: pieces cut by a window's edge are joined with what the next
window has of them, and of the spans that overlap the set with the highest total score stays
(weighted interval scheduling). Addresses and numbers of which the best path misses a part, or takes in
what is beside them, are taken whole. A span counts only if it passes its kind's check and lies outside
the base spans, which always stay.

Every check asks for a digit, an ``@`` or a bracketed ``at``. Windows that overlap none of these nor a
bracketed ``dot`` are not decoded: they can at most hold a piece of a span that is longer than a window.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm import tagger
from voltatlas.llm.tables import row_struct, with_row
from voltatlas.llm.tagger import PAD, Tagger, codes_of

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

WINDOW, STRIDE = 128, 64
SAMPLE_DOCS = 20_000  # documents of the sample, at most about
MAX_WINDOWS = 3_000  # labelled windows of a fit
COPIES = 2  # rewritten copies of a labelled window; two more if it holds a card or phone
STEPS = 420  # batches of a fit
_DECODED = 512  # windows decoded together

# The same languages as above, without repeated scans of long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(PHONE)
_HINT = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]")  # what the checks below ask for
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"\s*(?:@|[(\[]at[)\]])\s*")
_LAST_DOT = re.compile(r"\s*[(\[]dot[)\]]\s*$")
_NAMES = re.compile(r"[A-Za-z0-9-]*(?:(?:\.|\s*[(\[]dot[)\]]\s*)[A-Za-z0-9-]+)*")

Span = tuple[str, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns that pass their checks, by kind and then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text)
                    if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


_CHECKS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[(\[]at[)\]])\s*[A-Za-z0-9-]+(?:\s*(?:\.|[(\[]dot[)\]])\s*[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\[?\.\]?| \. )[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20./_-]{0,2}[0-9])+"),
    "phone": re.compile(r"\+?\x20?[0-9(][\x20()./0-9-]+[0-9]"),
}


def plausible(kind: str, text: str) -> bool:
    """Whether a span found by the tagger has its kind's form."""
    if not _CHECKS[kind].fullmatch(text):
        return False
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "ip":
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", text))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", text)) > 1
    return True


def _whole_email(text: str, a: int, b: int) -> tuple[int, int]:
    """The span with its local part and last names whole, of which the best path may miss characters."""
    at = None
    for m in _AT.finditer(text, max(0, a - WINDOW), b):
        if m.start() >= a or _NAMES.fullmatch(text, m.end(), max(a, m.end())):
            at = m
            break
    if at is None:
        return a, b
    a = at.start()
    while a > 0 and text[a - 1] in _LOCAL and at.start() - a < WINDOW:
        a -= 1
    b = max(at.end(), b)
    while b > at.end() and text[b - 1] in ".,;:":
        b -= 1
    b -= len(m.group()) if (m := _LAST_DOT.search(text[at.end():b])) else 0
    whole = _NAMES.match(text, b, b + WINDOW).end()
    if not plausible("email", text[a:whole]):  # the best path may also run into the next word
        whole = _NAMES.match(text, at.end(), at.end() + WINDOW).end()
    return a, whole


_RUNS = {
    "card": re.compile(r"[0-9]+(?:[\x20./_-]{1,2}[0-9]+)*"),
    "ip": re.compile(r"[0-9]+(?:(?:\[?\.\]?| \. )[0-9]+)*"),
}


def _whole_number(kind: str, text: str, a: int, b: int) -> tuple[str, int, int]:
    """The card or address of whole digit groups that overlaps the span most, if the span itself is none.

    The best path may miss groups of a number or take in the number beside it. Candidates are neighbouring groups
    with the kind's separators that pass its check; a phone of too many digits is tried as a card. Of equal
    overlaps the one closest in length and then the first is taken. Without one the span stays as it is.
    """
    if kind == "email" or plausible(kind, text[a:b]):
        return kind, a, b
    low, high = max(0, a - WINDOW // 2), min(len(text), b + WINDOW // 2)
    best = None
    for name in ("ip",) if kind == "ip" else ("card",):
        for run in _RUNS[name].finditer(text, low, high):
            if run.start() >= b or run.end() <= a:
                continue
            groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
            # A group that goes on beyond the reach is none.
            groups = [(x, y) for x, y in groups if not (
                (x == low and x > 0 and text[x - 1] in "0123456789")
                or (y == high and y < len(text) and text[y] in "0123456789"))]
            for i, (x, _) in enumerate(groups):
                for _, y in groups[i:i + 19]:
                    shared = min(y, b) - max(x, a)
                    if shared > 0 and y - x <= WINDOW // 2 and plausible(name, text[x:y]):
                        best = min(best or (1, 0, 0, 0, ""), (-shared, abs((y - x) - (b - a)), x, y, name))
    return (best[4], best[2], best[3]) if best else (kind, a, b)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that overlap a digit, an ``@`` or a bracketed at or dot; the last one may be short."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) if len(text) > WINDOW else 0
    out: list[int] = []
    for m in _HINT.finditer(text):
        first, end = m.span()
        for k in range(max(0, -(-(first - WINDOW + 1) // STRIDE)), min(last, (end - 1) // STRIDE) + 1):
            if not out or k * STRIDE > out[-1]:
                out.append(k * STRIDE)
    return out


def _spans_of(path: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind number, start, end, score) of the labels of one window."""
    out = []
    t, n = 0, len(path)
    while t < n:
        if path[t] % 2 == 1:
            kind, start = path[t] // 2, t
            t += 1
            while t < n and path[t] == 2 * kind + 2:
                t += 1
            own = np.where(np.arange(start, t) == start, 2 * kind + 1, 2 * kind + 2)
            gain = scores[np.arange(start, t), own] - scores[start:t, 0]
            out.append((int(kind), start, t, float(gain.sum())))
        else:
            t += 1
    return out


def reconcile(found: list[tuple[str, int, int, float, bool]]) -> list[Span]:
    """Spans ``kind, start, end, score, cut`` of all windows of a text to disjoint spans.

    Overlapping pieces of one kind of which one is cut by a window's edge are joined. Of the
    spans left, the disjoint set with the highest total score stays; on a tie the one that ends
    first.
    """
    joined: list[list] = []
    for kind, start, end, score, cut in sorted(found):
        same = next((j for j in reversed(joined) if j[0] == kind), None)
        if same and start < same[2] and (cut or same[4]) and (start, end) != (same[1], same[2]):
            same[4] = same[4] if same[2] >= end else cut
            same[2], same[3] = max(same[2], end), max(same[3], score)
        elif not same or (start, end) != (same[1], same[2]):
            joined.append([kind, start, end, score, cut])
        else:
            same[3], same[4] = max(same[3], score), same[4] and cut
    spans = sorted(joined, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]  # total score of the first i spans, last one taken
    for i, (_, start, _, score, _) in enumerate(spans):
        before = bisect.bisect_right(ends, start, 0, i)
        taken = best[before][0] + score
        best.append((taken, i) if taken > best[i][0] else (best[i][0], -1))
    out, i = [], len(spans)
    while i:
        if best[i][1] < 0:
            i -= 1
            continue
        kind, start, end = spans[i - 1][:3]
        out.append((kind, start, end))
        i = bisect.bisect_right(ends, start, 0, i - 1)
    return out[::-1]


def found_by_tagger(model: Tagger, texts: Sequence[str], every: bool = False) -> list[list[Span]]:
    """Reconciled spans of each text. ``every`` decodes all windows, for comparison."""
    places = []
    for i, text in enumerate(texts):
        starts = range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE) if every else window_starts(text)
        places += [(i, s) for s in starts if s < max(1, len(text))]
    raw: list[list[tuple[str, int, int, float, bool]]] = [[] for _ in texts]
    for k in range(0, len(places), _DECODED):
        part = places[k:k + _DECODED]
        x = np.full((len(part), WINDOW), PAD)
        lengths = np.zeros(len(part), dtype=np.int64)
        for j, (i, s) in enumerate(part):
            codes = codes_of(texts[i][s:s + WINDOW])
            x[j, :len(codes)], lengths[j] = codes, len(codes)
        path, scores = model.decode(x, lengths)
        for j in np.flatnonzero(path.any(axis=1)):
            i, s = part[j]
            n = lengths[j]
            for kind, a, b, score in _spans_of(path[j, :n], scores[j, :n]):
                cut = (a == 0 and s > 0) or (b == n and s + n < len(texts[i]))
                raw[i].append((KINDS[kind], s + a, s + b, score, cut))
    return [reconcile(spans) for spans in raw]


def all_spans(model: Tagger | None, texts: Sequence[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and the spans that the tagger adds, for each text."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = []
    for text, own, spans in zip(
            texts, base, found_by_tagger(model, texts) if model else [[] for _ in texts], strict=True):
        taken = sorted((a, b) for _, a, b in own)
        starts = [a for a, _ in taken]
        kept = []
        for kind, a, b in spans:
            inner = text[a:b]
            a, b = a + len(inner) - len(inner.lstrip()), b - (len(inner) - len(inner.rstrip()))
            if kind == "email":
                a, b = _whole_email(text, a, b)
            kind, a, b = _whole_number(kind, text, a, b)
            k = bisect.bisect_left(starts, b)
            free = not any(y > a for _, y in taken[max(0, k - len(KINDS)):k]) and not (kept and kept[-1][2] > a)
            if a < b and free and plausible(kind, text[a:b]):
                kept.append((kind, a, b))
        more.append(kept)
    return base, more


def labelled_windows(text: str) -> list[tuple[str, list[Span]]]:
    """Windows with a hint (see ``window_starts``), with the base spans that they hold whole."""
    spans = base_spans(text)
    out = []
    for s in window_starts(text):
        e = min(len(text), s + WINDOW)
        if any(a < s < b or a < e < b for _, a, b in spans):
            continue
        out.append((text[s:e], [(k, a - s, b - s) for k, a, b in spans if s <= a and b <= e]))
    return out


def _rewritten(kind: str, text: str, rng: np.random.Generator) -> str:
    """The same datum in a form that the base patterns do not take."""
    if kind == "email":
        if rng.random() < 0.5:
            bare = re.sub(r"[._%+-]?[0-9]+", "", text)
            text = bare if re.fullmatch(EMAIL, bare) else text
            # Other names, so that it learns the form and not the hosts of the sample.
            text = re.sub(r"[A-Za-z]+", lambda m: "".join(
                chr(c) for c in rng.integers(97, 123, int(rng.integers(2, 11)))), text)
        at = rng.choice([" @ ", "@ ", " (at) ", "(at)", " [at] ", "[at]"])
        local, domain = text.split("@")
        if "at" in at and rng.random() < 0.5:
            domain = domain.replace(".", at.replace("at", "dot"))
        return local + at + domain
    if kind == "ip":
        return text.replace(".", "[.]" if rng.random() < 0.5 else " . ")
    if kind == "card":
        digits = "".join(c for c in text if c.isdigit())
        mark = rng.choice([".", "/", "_", "  "])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    digits = [d for d in re.split(r"[^0-9]+", text) if d]
    return rng.choice(["", "(", "+ "]) + rng.choice([" ", "-", ".", "/"]).join(digits)


def training_set(
    windows: Sequence[tuple[str, list[Span]]], seed: int = 11,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and lengths: every window, and those with spans again with rewritten spans."""
    rng = np.random.default_rng(seed)
    items = []
    for text, spans in windows:
        items.append((text, spans))
        hard = any(k in ("card", "phone") for k, *_ in spans)
        for _ in range((COPIES + 2 * hard) if spans else 0):
            new, moved, at = "", [], 0
            for kind, a, b in sorted(spans, key=lambda s: s[1]):
                if a < at:
                    continue
                new += text[at:a]
                form = _rewritten(kind, text[a:b], rng)
                form = form if form.count("(") == form.count(")") else form.replace("(", "")
                moved.append((kind, len(new), len(new) + len(form)))
                new, at = new + form, b
            new += text[at:]
            items.append((new[:WINDOW], [s for s in moved if s[2] <= WINDOW]))
    x = np.full((len(items), WINDOW), PAD)
    y = np.zeros((len(items), WINDOW), dtype=np.int8)
    lengths = np.zeros(len(items), dtype=np.int64)
    for i, (text, spans) in enumerate(items):
        codes = codes_of(text)
        x[i, :len(codes)], lengths[i] = codes, len(codes)
        for kind, a, b in spans:
            y[i, a], y[i, a + 1:b] = 2 * KINDS.index(kind) + 1, 2 * KINDS.index(kind) + 2
    return x, y, lengths


def train(
    docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, max_windows: int = MAX_WINDOWS,
) -> Tagger | None:
    """Fit on at most ``max_windows`` windows of about ``sample_docs`` documents.

    Both are chosen by a hash of the text, so reruns agree; two thirds of the windows hold spans if
    there are as many. None if the sample holds no span: only base spans are then found.
    """
    rows = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), F.col("text")), F.lit(1 << 40)) / float(1 << 40)
    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").select(
        "text", draw.alias("draw")).filter(F.col("draw") < F.lit(min(1.0, sample_docs / max(rows, 1))))
    span = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = labelled_windows(text)
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w for w, _ in own]),
                         pa.array([[{"kind": k, "a": a, "b": b} for k, a, b in s] for _, s in own], span)],
                        names=["window", "spans"])

    schema = "window string, spans array<struct<kind:string,a:int,b:int>>"
    windows = texts.select("text").mapInArrow(run, schema).distinct()
    order = F.xxhash64("window")
    marked = windows.withColumn("kinds", F.size("spans") > 0).withColumn("order", order)
    good = marked.filter("kinds").orderBy("order", "window").limit(2 * max_windows // 3).collect()
    if not good:
        return None
    plain = marked.filter("not kinds").orderBy("order", "window").limit(max_windows - len(good)).collect()
    x, y, lengths = training_set(
        [(r["window"], [(s["kind"], s["a"], s["b"]) for s in r["spans"]]) for r in good + plain])
    return tagger.fit(x, y, lengths, KINDS, steps=STEPS)


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(
    docs: DataFrame, model: Tagger | None, text_col: str = "text", carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of carried columns), counts, hash and spans.

    ``n_email, n_ip, n_card, n_phone`` count base spans, ``n_added`` those of the tagger;
    ``base_sha256`` is the hash of the joined base spans; ``spans`` has all as ``kind, start, end``,
    by kind and then start. NULL and empty texts have none (the hash is that of the empty string).
    Whole texts are read in overlapping windows, so a text's length only costs time. Rows are
    independent: no shuffle; repeated rows agree. ``model`` None leaves the base spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base, more = all_spans(shared.value, texts)
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                both = [sorted(b + m, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                        for b, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *counts, pa.array([len(m) for m in more], pa.int64()),
                     pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                     pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in both], span)],
                    names=["row", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    return docs.select(row_struct(docs, carry), docs[text_col].alias("text")).mapInArrow(
        run, with_row(
            docs, carry, **{f"n_{k}": T.LongType() for k in (*KINDS, "added")},
            base_sha256=T.StringType(), spans=T.ArrayType(T.StructType([
                T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType())]))))
