"""A bidirectional LSTM in numpy that labels every block of a page."""

from __future__ import annotations

import numpy as np

HIDDEN = 16


class Recurrent:
    """Two LSTM passes over a sequence of block vectors and a logistic output per block."""

    def __init__(self, inputs: int, seed: int):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.weights = {}
        for side in ("f", "b"):
            self.weights[f"W{side}"] = rng.standard_normal((inputs, 4 * h)) * 0.1
            self.weights[f"R{side}"] = rng.standard_normal((h, 4 * h)) * h**-0.5 * 0.5
            self.weights[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.weights["o"] = rng.standard_normal(2 * h) * 0.1
        self.weights["o0"] = np.zeros(1)

    def _run(self, x: np.ndarray, real: np.ndarray, side: str, keep: bool):
        """Hidden states (batch, time, h) of one direction; padded places pass the state on."""
        w, h = self.weights, HIDDEN
        steps = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        given = x @ w[f"W{side}"] + w[f"c{side}"]
        state, cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        out = np.zeros((len(x), x.shape[1], h))
        trail = []
        for t in steps:
            a = given[:, t] + state @ w[f"R{side}"]
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h], -30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(a[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = real[:, t, None]
            if keep:
                trail.append((t, state, cell, i, f, o, g, squashed, m))
            state, cell = np.where(m, o * squashed, state), np.where(m, new, cell)
            out[:, t] = state
        return out, trail

    def log_odds(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, real, s, False)[0] for s in "fb"], axis=2)
        return both @ self.weights["o"] + self.weights["o0"]

    def gradients(self, x: np.ndarray, real: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.weights, HIDDEN
        runs = {s: self._run(x, real, s, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ w["o"] + w["o0"], -30, 30)))
        d = (p - wanted) * real / max(1, real.sum())
        out = {"o": np.einsum("bt,bth->h", d, both), "o0": np.array([d.sum()])}
        d_both = d[:, :, None] * w["o"]
        for n, side in enumerate("fb"):
            d_given = np.zeros((*x.shape[:2], 4 * h))
            d_state, d_cell = np.zeros((len(x), h)), np.zeros((len(x), h))
            out[f"R{side}"] = np.zeros_like(w[f"R{side}"])
            for t, state, cell, i, f, o, g, squashed, m in reversed(runs[side][1]):
                total = d_state + d_both[:, t, n * h : (n + 1) * h]
                inner = np.where(m, total, 0)
                d_o, d_new = inner * squashed, inner * o * (1 - squashed**2) + np.where(m, d_cell, 0)
                a = np.concatenate(
                    [d_new * g * i * (1 - i), d_new * cell * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - g**2)], axis=1
                )
                d_given[:, t] = a
                out[f"R{side}"] += state.T @ a
                d_state = a @ w[f"R{side}"].T + np.where(m, 0, total)
                d_cell = np.where(m, d_new * f, d_cell)
            flat = d_given.reshape(-1, 4 * h)
            out[f"W{side}"], out[f"c{side}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int, blank: float, paths: int) -> None:
        """``blank``: share of blocks whose ``paths`` first inputs are hidden, so that words and context are learnt too."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        step = 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, real, y = padded([pages[i] for i in groups[g]])
                x[:, :, :paths] *= rng.random(x.shape[:2])[:, :, None] >= blank
                step += 1
                for k, d in self.gradients(x, real, y).items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d**2 - second[k])
                    self.weights[k] -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), longest, pages[0][0].shape[1]))
    real, y = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest))
    for i, (vectors, wanted) in enumerate(pages):
        x[i, : len(wanted)], y[i, : len(wanted)], real[i, : len(wanted)] = vectors, wanted, True
    return x, real, y
