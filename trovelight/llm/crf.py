"""A linear-chain conditional random field: features by name, training by gradient, decoding by Viterbi in NumPy batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from trovelight.llm.common import bounded_chunks

#: Most label scores (positions of a padded batch) held at a time.
AREA = 1 << 16


@dataclass(frozen=True)
class Model:
    """`ids` names the rows of `weights` (features x labels); row 0 stands for unknown features and stays zero."""

    labels: tuple[str, ...]
    ids: dict[str, int]
    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray


Sequences = Sequence[Sequence[Sequence[str]]]


def _pad(sequences: Sequences, ids: dict[str, int], slots: int) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, sequences))
    out, size = np.zeros((len(sequences), longest, slots), np.int32), np.array([len(s) for s in sequences])
    for s, sequence in enumerate(sequences):
        for t, features in enumerate(sequence):
            for k, f in enumerate(features):
                out[s, t, k] = ids.get(f, 0)
    return out, size


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(sequences: Sequences, tags: Sequence[Sequence[str]], labels: Sequence[str], rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole (small) table; the same result every time."""
    names = sorted({f for s in sequences for t in s for f in t})
    ids, n = {f: i + 1 for i, f in enumerate(names)}, len(labels)
    slots = max(len(t) for s in sequences for t in s)
    x, size = _pad(sequences, ids, slots)
    place = {label: i for i, label in enumerate(labels)}
    batch, longest, _ = x.shape
    y = np.zeros((batch, longest), int)
    for s, row in enumerate(tags):
        y[s, : len(row)] = [place[t] for t in row]
    live = np.arange(longest) < size[:, None]
    flat = x.ravel()
    params = [np.zeros((len(names) + 1, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    one = np.eye(n)[y] * live[..., None]
    true_step = np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:])
    for i in range(1, rounds + 1):
        weights, step, start = params
        emit = weights[x].sum(2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + start
        for t in range(1, longest):
            new = _log_sum(forward[:, t - 1, :, None] + step, 1) + emit[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(step + (emit[:, t + 1] + backward[:, t + 1])[:, None], 2)
            backward[:, t] = np.where(live[:, t + 1, None], new, 0)
        total = _log_sum(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * live[..., None]
        edge = np.exp(forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None] - total[:, None, None, None]) * live[:, 1:, None, None]
        gap = one - node
        grown = np.stack([np.bincount(flat, np.repeat(gap[..., k].ravel(), slots), len(names) + 1) for k in range(n)], 1)
        grown[0] = 0
        gradients = [grown / batch - decay * weights, (true_step - edge.sum((0, 1))) / batch - decay * step, gap[:, 0].sum(0) / batch - decay * start]
        for p, g, (m, v) in zip(params, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        params[0][0] = 0
    return Model(tuple(labels), ids, *params)


def _viterbi(emit: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    batch, longest, n = emit.shape
    score, back = emit[:, 0] + model.start, np.zeros((batch, longest, n), np.int8)
    for t in range(1, longest):
        to = score[:, :, None] + model.step
        best = to.argmax(1)
        new = np.take_along_axis(to, best[:, None], 1)[:, 0] + emit[:, t]
        going = (t < size)[:, None]
        back[:, t] = np.where(going, best, np.arange(n))
        score = np.where(going, new, score)
    out = np.zeros((batch, longest), int)
    out[:, -1] = score.argmax(1)
    for t in range(longest - 1, 0, -1):
        out[:, t - 1] = back[np.arange(batch), t, out[:, t]]
    return out


def decode(sequences: Sequences, model: Model, slots: int) -> list[list[str]]:
    """The best labels of each sequence; sequences of like length share a batch."""
    found: list[list[str]] = [[] for _ in sequences]
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    for a, b in bounded_chunks([len(sequences[i]) for i in order], AREA):
        x, size = _pad([sequences[i] for i in order[a:b]], model.ids, slots)
        path = _viterbi(model.weights[x].sum(2), size, model)
        for i, row, n in zip(order[a:b], path, size, strict=True):
            found[i] = [model.labels[k] for k in row[:n]]
    return found
