"""A character-level bidirectional LSTM with CRF transitions, in numpy: fit and batch decoding.

Labels are O and, for each kind, a first and an inner label. Transitions that break a span (an
inner label after anything but its own kind) are forbidden in training and decoding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
LETTER, OTHER, PAD = 128, 129, 130  # codes beyond ASCII
CODES = 131
_NEVER = -1e4


def codes_of(text: str) -> np.ndarray:
    """Codes of the characters: ASCII as it is, all other letters alike, everything else alike."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        points[i] = LETTER if text[i].isalpha() else OTHER
    return points


def label_count(kinds: Sequence[str]) -> int:
    return 1 + 2 * len(kinds)


def allowed_transitions(labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of forbidden moves: an inner label needs its first or itself in front."""
    start = np.zeros(labels)
    move = np.zeros((labels, labels))
    for inner in range(2, labels, 2):
        start[inner] = _NEVER
        move[:, inner] = _NEVER
        move[inner - 1, inner] = move[inner, inner] = 0.0
    return start, move


@dataclass
class Tagger:
    params: dict[str, np.ndarray]
    kinds: tuple[str, ...]

    @property
    def labels(self) -> int:
        return label_count(self.kinds)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores of ``x`` (windows x characters), as windows x characters x labels."""
        p = self.params
        forward = _lstm(x, p["wf"], p["uf"])[0]
        backward = _lstm(x[:, ::-1], p["wb"], p["ub"])[0][:, ::-1]
        return np.concatenate((forward, backward), axis=2) @ p["wo"] + p["bo"]

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (0 beyond a window's length) and emissions."""
        scores = self.emissions(x).astype(np.float64)
        start, move = self._transitions()
        n, steps, labels = scores.shape
        best = scores[:, 0] + start
        back = np.zeros((steps, n, labels), dtype=np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + move[None]
            back[t] = options.argmax(axis=1)
            new = options.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        path = np.zeros((n, steps), dtype=np.int8)
        now = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            inside = t < lengths
            path[:, t] = np.where(inside, now, 0)
            if t:
                now = np.where(inside, back[t][rows, now], now)
        return path, scores

    def _transitions(self) -> tuple[np.ndarray, np.ndarray]:
        start, move = allowed_transitions(self.labels)
        return start + self.params["start"], move + self.params["move"]


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states of one direction; ``w`` holds a row of gate inputs for each code."""
    n, steps = x.shape
    size = u.shape[0]
    h = np.zeros((n, size), dtype=w.dtype)
    c = np.zeros_like(h)
    out = np.empty((n, steps, size), dtype=w.dtype)
    tape = []
    for t in range(steps):
        z = w[x[:, t]] + h @ u
        gates = _sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        c_new = f * c + i * g
        s = np.tanh(c_new)
        if keep:
            tape.append((h, c, i, f, o, g, s))
        h, c = o * s, c_new
        out[:, t] = h
    return out, tape


def _lstm_back(x, w, u, tape, d_out):
    """Gradients of the gate inputs and the recurrent matrix, from those of the hidden states."""
    n, steps = x.shape
    size = u.shape[0]
    before, c, i, f, o, g, s = (np.stack(part) for part in zip(*tape, strict=True))
    to_cell = o * (1 - s * s)
    by_cell = np.stack((g * i * (1 - i), c * f * (1 - f), i * (1 - g * g)), axis=1)
    by_out = s * o * (1 - o)
    dz = np.empty((steps, n, 4, size), dtype=w.dtype)
    gates = dz.reshape(steps, n, 4 * size)
    dh_next = np.zeros((n, size), dtype=w.dtype)
    dc = np.zeros_like(dh_next)
    for t in range(steps - 1, -1, -1):
        dh = d_out[:, t] + dh_next
        dc = dc + dh * to_cell[t]
        dz[t, :, 0], dz[t, :, 1], dz[t, :, 3] = by_cell[t] * dc
        dz[t, :, 2] = dh * by_out[t]
        dh_next = gates[t] @ u.T
        dc = dc * f[t]
    # Rows of one code lie together, to be added up at once.
    codes = x.T.reshape(-1)
    order = np.argsort(codes, kind="stable")
    found, first = np.unique(codes[order], return_index=True)
    dw = np.zeros_like(w)
    dw[found] = np.add.reduceat(gates.reshape(-1, 4 * size)[order], first, axis=0)
    # A product for each character, added up: one large product would start threads that spin.
    return dw, (before.transpose(0, 2, 1) @ gates).sum(axis=0)


def crf_gradients(scores, start, move, labels, lengths):
    """Mean negative log-likelihood of the label paths, and its gradients by forward-backward.

    Forward and backward sums are kept as probabilities scaled to 1 at each character, so that a
    step is one matrix product; the logarithms of the scales add up to the total.
    """
    n, steps, k = scores.shape
    rows = np.arange(n)
    inside = np.arange(steps) < lengths[:, None]
    top = scores.max(axis=2)
    weight = np.exp(scores - top[:, :, None])
    step_weight = np.exp(move)
    high = start.max()
    alpha = np.empty((steps, n, k))
    scale = np.ones((steps, n))
    now = np.exp(start - high) * weight[:, 0]
    for t in range(steps):
        if t:
            now = (alpha[t - 1] @ step_weight) * weight[:, t]
        total = np.maximum(now.sum(axis=1), 1e-300)
        scale[t] = np.where(inside[:, t], total, 1.0)
        alpha[t] = np.where(inside[:, t, None], now / total[:, None], alpha[t - 1] if t else now)
    loss = (np.log(scale) + np.where(inside, top, 0.0).T).sum(axis=0) + high
    beta = np.ones((n, k))
    d_scores = np.empty_like(scores)
    after = np.zeros((steps, n, k))  # what a move into each label is worth, per scale
    for t in range(steps - 1, -1, -1):
        d_scores[:, t] = alpha[t] * beta * inside[:, t, None]
        if t:
            after[t] = weight[:, t] * beta * (inside[:, t] / scale[t])[:, None]
            beta = np.where(inside[:, t, None], after[t] @ step_weight.T, beta)
    first = d_scores[:, 0].sum(axis=0)
    d_move = step_weight * (alpha[:-1].transpose(0, 2, 1) @ after[1:]).sum(axis=0)
    at, t = np.nonzero(inside)
    d_scores[at, t, labels[at, t]] -= 1.0
    np.subtract.at(first, labels[:, 0], 1.0)
    at, t = np.nonzero(inside[:, 1:])
    pairs = labels[at, t], labels[at, t + 1]
    np.subtract.at(d_move, pairs, 1.0)
    gold = np.where(inside, scores[rows[:, None], np.arange(steps), labels], 0.0).sum() + start[
        labels[:, 0]].sum() + move[pairs].sum()
    return (loss.sum() - gold) / n, d_scores / n, first / n, d_move / n


def fit(
    windows: np.ndarray, labels: np.ndarray, lengths: np.ndarray, kinds: Sequence[str],
    steps: int = 240, batch: int = 64, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 5,
) -> Tagger:
    """Train on windows of codes with labels, by Adam over seeded batches. Reruns agree."""
    rng = np.random.default_rng(seed)
    k = label_count(kinds)

    def random(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {
        "wf": random(CODES, 4 * hidden, scale=0.1), "uf": random(hidden, 4 * hidden, scale=hidden ** -0.5),
        "wb": random(CODES, 4 * hidden, scale=0.1), "ub": random(hidden, 4 * hidden, scale=hidden ** -0.5),
        "wo": random(2 * hidden, k, scale=0.1), "bo": np.zeros(k, np.float32),
        "start": np.zeros(k), "move": np.zeros((k, k))}
    for w in ("wf", "wb"):
        p[w][:, hidden:2 * hidden] += 1.0  # remember at first
    mean = {name: np.zeros_like(v) for name, v in p.items()}
    square = {name: np.zeros_like(v) for name, v in p.items()}
    ban_start, ban_move = allowed_transitions(k)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(batch, len(windows)))
        size = int(lengths[pick].max())
        x, y, n = windows[pick, :size], labels[pick, :size].astype(np.int64), lengths[pick]
        hf, tape_f = _lstm(x, p["wf"], p["uf"], keep=True)
        hb, tape_b = _lstm(x[:, ::-1], p["wb"], p["ub"], keep=True)
        both = np.concatenate((hf, hb[:, ::-1]), axis=2)
        scores = (both @ p["wo"] + p["bo"]).astype(np.float64)
        _, d_scores, d_start, d_move = crf_gradients(scores, ban_start + p["start"], ban_move + p["move"], y, n)
        d = d_scores.astype(np.float32)
        d_both = d @ p["wo"].T
        grads = {
            "wo": np.einsum("nth,ntk->hk", both, d), "bo": d.sum(axis=(0, 1)),
            "start": d_start, "move": d_move}
        grads["wf"], grads["uf"] = _lstm_back(x, p["wf"], p["uf"], tape_f, d_both[:, :, :hidden])
        grads["wb"], grads["ub"] = _lstm_back(
            x[:, ::-1], p["wb"], p["ub"], tape_b, d_both[:, ::-1, hidden:])
        pace = rate * min(1.0, 2.0 * (steps - step + 1) / steps)
        for name, g in grads.items():
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            change = (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.99 ** step)) + 1e-6)
            p[name] = (p[name] - pace * change).astype(p[name].dtype)
    return Tagger(p, tuple(kinds))
