"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: ASCII characters, letters beyond them, everything else.
CLASSES = 130
EMBED, HIDDEN = 12, 16
NEVER = -1e4


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = np.minimum(points, CLASSES - 1)
    far = np.flatnonzero(points >= 128)
    out[far] = [128 if chr(p).isalpha() else 129 for p in points[far].tolist()]
    return out


class Network(NamedTuple):
    """Parameters by name; transitions that tags don't allow are NEVER in `barred`."""

    params: dict[str, np.ndarray]
    barred: np.ndarray

    @property
    def transitions(self) -> np.ndarray:
        return self.params["trans"] + self.barred


def new_network(tags: int, barred: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    params = {"embed": normal(CLASSES, EMBED), "out": normal(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        params |= {f"x{d}": normal(EMBED, 4 * HIDDEN), f"h{d}": normal(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
    return Network(params, barred.astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _run(inputs: np.ndarray, recur: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states [T, B, H] from gate inputs [T, B, 4H]; keep gets what training needs."""
    steps, batch, _ = inputs.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    for t in range(steps):
        z = inputs[t] + h @ recur
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before_h, before_c = h, c
        c = f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, g, tanh_c, before_h, before_c))
    return out


def _run_back(grad_out: np.ndarray, recur: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs [T, B, 4H] and of the recurrent weights."""
    steps, batch, _ = grad_out.shape
    grads = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    dh = np.zeros((batch, HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    d_recur = np.zeros_like(recur)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tanh_c, before_h, before_c = kept[t]
        dh = dh + grad_out[t]
        dc = dc + dh * o * (1 - tanh_c**2)
        grads[t] = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        d_recur += before_h.T @ grads[t]
        dh = grads[t] @ recur.T
        dc = dc * f
    return grads, d_recur


def emissions(net: Network, chars: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Tag scores [T, B, tags] of windows of character classes [T, B]."""
    p = net.params
    hidden = []
    for d in "fb":
        own = chars if d == "f" else chars[::-1]
        keep: list | None = None if kept is None else []
        states = _run((p["embed"] @ p[f"x{d}"] + p[f"b{d}"])[own], p[f"h{d}"], keep)
        if kept is not None:
            kept[d] = keep
        hidden.append(states if d == "f" else states[::-1])
    both = np.concatenate(hidden, axis=2)
    if kept is not None:
        kept["both"] = both
    return both @ p["out"] + p["out_b"]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def loss_and_gradients(net: Network, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of tag paths [T, B], by the forward-backward sums."""
    p, kept = net.params, {}
    scores = emissions(net, chars, kept)
    trans = net.transitions
    steps, batch, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[-1], 1)
    rows = np.arange(batch)
    gold = sum(scores[t, rows, tags[t]] for t in range(steps)) + sum(trans[tags[t - 1], tags[t]] for t in range(1, steps))
    d_scores = np.exp(alpha + beta - total[None, :, None])
    d_trans = np.zeros((k, k), np.float32)
    for t in range(1, steps):
        d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(d_trans, (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        d_scores[t, rows, tags[t]] -= 1
    d_scores, d_trans = d_scores / batch, d_trans / batch
    grads = {"trans": d_trans * (net.barred > NEVER / 2), "out_b": d_scores.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
    grads["out"] = kept["both"].reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, k)
    d_both = d_scores @ p["out"].T
    for d in "fb":
        own, part = (chars, d_both[:, :, :HIDDEN]) if d == "f" else (chars[::-1], d_both[::-1, :, HIDDEN:])
        g, grads[f"h{d}"] = _run_back(part, p[f"h{d}"], kept[d])
        flat, of = g.reshape(-1, 4 * HIDDEN), own.reshape(-1)
        grads[f"b{d}"] = flat.sum(axis=0)
        by_class = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        np.add.at(by_class, of, flat)
        grads[f"x{d}"] = p["embed"].T @ by_class
        grads["embed"] += by_class @ p[f"x{d}"].T
    return float((total - gold).mean()), grads


def train(net: Network, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> Network:
    """Adam over seeded batches of windows [N, T]."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    params = dict(net.params)
    for step in range(1, steps + 1):
        some = rng.integers(0, len(chars), batch)
        _, grads = loss_and_gradients(Network(params, net.barred), chars[some].T, tags[some].T)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(params, net.barred)


def best_path(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Viterbi tags of one sequence of scores [T, tags]."""
    steps, k = scores.shape
    back = np.empty((steps, k), np.int64)
    total = scores[0]
    for t in range(1, steps):
        through = total[:, None] + transitions
        back[t] = through.argmax(axis=0)
        total = through[back[t], np.arange(k)] + scores[t]
    path = np.empty(steps, np.int64)
    path[-1] = total.argmax()
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
