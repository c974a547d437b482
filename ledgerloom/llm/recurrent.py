"""A bidirectional gated recurrent layer with attention pooling, forward and backward, in numpy.

``Layer`` reads sequences of equal padded length with a mask, both ways, and returns for each the mean
of the states weighted by attention.  ``gradients`` gives the gradients of its weights and its input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Arrays = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Layer:
    weights: Arrays
    hidden: int

    @classmethod
    def new(cls, width: int, hidden: int, rng: np.random.Generator) -> Layer:
        def some(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        w: Arrays = {"a": some(2 * hidden, hidden), "u": some(hidden, 1) * np.float32(0.5)}
        for way in "fb":
            w["x" + way], w["h" + way] = some(width, 3 * hidden), some(hidden, 3 * hidden)
            w["b" + way] = np.zeros(3 * hidden, np.float32)
        return cls(w, hidden)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the gates get from the input, for both ways."""
        return tuple(x @ self.weights["x" + way] + self.weights["b" + way] for way in "fb")

    def _states(self, given: np.ndarray, mask: np.ndarray, way: str, kept: list | None) -> np.ndarray:
        h, n = self.hidden, given.shape[1]
        state, out = np.zeros((len(given), h), np.float32), np.empty((len(given), n, h), np.float32)
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            own = state @ self.weights["h" + way]
            gates = sigmoid(given[:, t, :2 * h] + own[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, t, 2 * h:] + r * own[:, 2 * h:])
            after = new + z * (state - new)
            after = np.where(mask[:, t, None], after, state)
            if kept is not None:
                kept.append((t, state, z, r, new, own[:, 2 * h:]))
            state = out[:, t] = after
        return out

    def pooled(self, given: tuple[np.ndarray, np.ndarray], mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Attention-weighted state of each sequence, from projected inputs."""
        steps: dict[str, list] | dict[str, None] = {"f": [], "b": []} if kept is not None else {"f": None, "b": None}
        states = np.concatenate([self._states(given[0], mask, "f", steps["f"]),
                                 self._states(given[1], mask, "b", steps["b"])], axis=2)
        side = np.tanh(states @ self.weights["a"])
        score = (side @ self.weights["u"])[:, :, 0] + np.where(mask, 0, -1e9).astype(np.float32)
        score -= score.max(axis=1, keepdims=True)
        share = np.exp(score) * mask
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
        out = (share[:, None, :] @ states)[:, 0]
        if kept is not None:
            kept.update(steps=steps, states=states, side=side, share=share, mask=mask)
        return out

    def gradients(self, g_out: np.ndarray, x: np.ndarray, kept: dict) -> tuple[Arrays, np.ndarray]:
        h, w = self.hidden, self.weights
        states, side, share, mask = kept["states"], kept["side"], kept["share"], kept["mask"]
        g_share = (states @ g_out[:, :, None])[:, :, 0]
        g_states = share[:, :, None] * g_out[:, None, :]
        g_score = share * (g_share - (share * g_share).sum(axis=1, keepdims=True))
        g_pre = g_score[:, :, None] * w["u"][:, 0] * (1 - side * side)
        out: Arrays = {"u": np.tensordot(side, g_score, axes=([0, 1], [0, 1]))[:, None],
                       "a": np.tensordot(states, g_pre, axes=([0, 1], [0, 1]))}
        g_states += g_pre @ w["a"].T
        g_x = np.zeros_like(x)
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            out["x" + way], out["h" + way], out["b" + way] = (np.zeros_like(w[n + way]) for n in "xhb")
            g = np.zeros((len(x), h), np.float32)
            for t, state, z, r, new, own in reversed(kept["steps"][way]):
                g = g + g_states[:, t, at]
                active = np.where(mask[:, t, None], g, 0)
                g_new = active * (1 - z) * (1 - new * new)
                g_z = active * (state - new) * z * (1 - z)
                g_r = g_new * own * r * (1 - r)
                g_gates = np.concatenate([g_z, g_r, g_new * r], axis=1)
                g_input = np.concatenate([g_z, g_r, g_new], axis=1)
                out["h" + way] += state.T @ g_gates
                out["x" + way] += x[:, t].T @ g_input
                out["b" + way] += g_input.sum(axis=0)
                g_x[:, t] += g_input @ w["x" + way].T
                g = (g - active) + active * z + g_gates @ w["h" + way].T
        return out, g_x
