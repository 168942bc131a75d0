"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 8, 16
SIDE_BY_SIDE = 512  # windows decoded at once
_NAMED = {c: i for i, c in enumerate("@.-+() _%,:/=\"'", 5)}
SYMBOLS = 5 + len(_NAMED) + 2


def symbols(text: str) -> np.ndarray:
    """Character classes: digits, small, capital and other letters, named marks, other white space, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 128)]


def _table() -> np.ndarray:
    out = np.full(129, SYMBOLS - 1, np.int64)
    for c in range(128):
        x = chr(c)
        out[c] = 1 if x.isdigit() else 2 if x.islower() else 3 if x.isupper() else _NAMED.get(x, SYMBOLS - 2 if x.isspace() else SYMBOLS - 1)
    out[128] = 4
    return out


_TABLE = _table()


def _squash(x):
    """From -1 to 1; a tenth of the time of ``tanh``, which would be most of what decoding takes."""
    return x / (1 + np.abs(x))


def _slope(y):
    """Derivative of ``_squash`` by its value."""
    return np.square(1 - np.abs(y))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _lstm(self, x, d):
        p, (t, n) = self.p, x.shape[:2]
        h = c = np.zeros((n, HIDDEN), np.float32)
        inputs = x @ p[f"x{d}"] + p[f"c{d}"]
        out, kept = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[s] + h @ p[f"h{d}"]
            z = _squash(z)
            gates = 0.5 + 0.5 * z[:, : 3 * HIDDEN]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = z[:, 3 * HIDDEN :]
            before, last = c, h
            c = f * c + i * g
            tc = _squash(c)
            h = o * tc
            out[s] = h
            kept.append((s, i, f, o, g, before, last, tc))
        return out, kept

    def _back(self, x, kept, d, dh_all, grads):
        p = self.p
        dh = dc = np.zeros_like(dh_all[0])
        dx = np.zeros_like(x)
        for s, i, f, o, g, before, last, tc in reversed(kept):
            dh = dh + dh_all[s]
            dc = dc + dh * o * _slope(tc)
            gate = lambda y: 0.5 * _slope(2 * y - 1)
            dz = np.concatenate((dc * g * gate(i), dc * before * gate(f), dh * tc * gate(o), dc * i * _slope(g)), axis=1)
            grads[f"x{d}"] += x[s].T @ dz
            grads[f"h{d}"] += last.T @ dz
            grads[f"c{d}"] += dz.sum(0)
            dx[s] = dz @ p[f"x{d}"].T
            dh = dz @ p[f"h{d}"].T
            dc = dc * f
        return dx

    def _emit(self, codes):
        """Emission scores (time, window, tag) of windows of symbols (window, time)."""
        x = self.p["embed"][codes.T]
        (hf, kf), (hb, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        h = np.concatenate((hf, hb), axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, h, kf, kb)

    def step(self, codes, gold):
        """Mean negative log-likelihood of the tag sequences and its gradients."""
        p, n, t = self.p, len(codes), codes.shape[1]
        e, (x, h, kf, kb) = self._emit(codes)
        e = e.astype(np.float64)
        move, start, y = p["move"].astype(np.float64), p["start"], gold.T
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for s in range(1, t):
            alpha[s] = _logsum(alpha[s - 1][:, :, None] + move, 1) + e[s]
        for s in range(t - 2, -1, -1):
            beta[s] = _logsum(move[None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        whole = _logsum(alpha[-1], 1)
        rows = np.arange(n)
        score = start[y[0]] + e[0, rows, y[0]]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        de = np.exp(alpha + beta - whole[None, :, None])
        for s in range(t):
            de[s, rows, y[s]] -= 1
        grads["start"] = (de[0].sum(0) / n).astype(np.float32)
        for s in range(1, t):
            score = score + move[y[s - 1], y[s]] + e[s, rows, y[s]]
            both = np.exp(alpha[s - 1][:, :, None] + move + (e[s] + beta[s])[:, None, :] - whole[:, None, None]).sum(0)
            np.subtract.at(both, (y[s - 1], y[s]), 1)
            grads["move"] += (both / n).astype(np.float32)
        de = (de / n).astype(np.float32)
        grads["out"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        grads["bias"] = de.sum((0, 1))
        dh = de @ p["out"].T
        dx = self._back(x, kf, "f", dh[:, :, :HIDDEN], grads) + self._back(x, kb, "b", dh[:, :, HIDDEN:], grads)
        np.add.at(grads["embed"], codes.T, dx)
        return float((whole - score).mean()), grads

    def fit(self, codes, gold, steps=420, batch=32, rate=0.02, seed=5):
        """Adam over ``steps`` shuffled batches; the same input gives the same model."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        while t < steps:
            order = rng.permutation(len(codes))
            for at in range(0, len(codes), batch):
                part, t = order[at : at + batch], t + 1
                _, grads = self.step(codes[part], gold[part])
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * max(0.05, 1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, codes):
        """The best tag sequence of every window (window, time)."""
        out = np.zeros(codes.shape, np.int8)
        for at in range(0, len(codes), SIDE_BY_SIDE):
            e = self._scores(codes[at : at + SIDE_BY_SIDE])
            which = np.flatnonzero(self._open(e))
            if len(which):
                out[at + which] = self._best(np.ascontiguousarray(e[:, :, which])).T
        return out

    def _scores(self, codes):
        """Emission scores (time, tag, window) as from ``_emit``, with the windows side by side and nothing kept for gradients."""
        p, (n, t) = self.p, codes.shape
        weights = [np.ascontiguousarray(np.vstack((p[f"h{d}"], p[f"x{d}"], p[f"c{d}"][None])).T) for d in "fb"]
        embed, codes = np.ascontiguousarray(p["embed"].T), np.ascontiguousarray(codes.T)
        both = np.empty((t, 2, HIDDEN, n), np.float32)
        z, size = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
        half, one = np.float32(0.5), np.float32(1)
        for d, w in enumerate(weights):
            state, c = np.zeros((HIDDEN + EMBED + 1, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            state[-1] = 1
            for s in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(embed, codes[s], axis=1, out=state[HIDDEN:-1], mode="clip")
                np.matmul(w, state, out=z)
                np.abs(z, out=size)
                size += one
                z /= size
                gates, kept = z[: 3 * HIDDEN], z[3 * HIDDEN :]
                gates *= half
                gates += half
                kept *= z[:HIDDEN]
                c *= z[HIDDEN : 2 * HIDDEN]
                c += kept
                np.abs(c, out=kept)
                kept += one
                np.divide(c, kept, out=kept)
                kept *= z[2 * HIDDEN : 3 * HIDDEN]
                state[:HIDDEN] = kept
                both[s, d] = kept
        e = np.matmul(np.ascontiguousarray(p["out"].T), both.reshape(t, 2 * HIDDEN, n))
        e += p["bias"][:, None]
        return e

    def _open(self, e):
        """Which windows may have a tag: in the others every step inside a span scores below the same step outside, whatever tags are before and behind it."""
        move = self.p["move"] - self.p["move"][0, 0]
        into, start, leave = move[:, 1:].max(), (self.p["start"] - self.p["start"][0])[1:].max(), max(0.0, move[1:, 0].max())
        gain = e[:, 1:].max(1) - e[:, 0]
        return (gain.max(0) + into + leave > -1e-3) | (gain[0] + start + leave > -1e-3)

    def _best(self, e):
        """Tags (time, window) of the best sequences."""
        t, _, n = e.shape
        best, move = e, self.p["move"]  # in place: the best score of a sequence that ends in each tag
        best[0] += self.p["start"][:, None]
        for s in range(1, t):
            best[s] += (best[s - 1][:, None] + move[:, :, None]).max(0)
        out = np.zeros((t, n), np.int8)
        out[-1] = best[-1].argmax(0)
        for s in range(t - 1, 0, -1):
            out[s - 1] = (best[s - 1] + move[:, out[s]]).argmax(0)
        return out
