"""A small causal self-attention language model, trained and run in numpy.

A position is a word, read as the sum of the vectors of its first, second and last subword id; the model
gives the chances of the subword id that begins the next word.  One attention layer with relative
position bias and one feed-forward layer.  A text is cut into blocks of ``BLOCK`` positions; the keys
of a block are the block before and its own, so windows of two blocks overlap by one, every position
is scored once, and a batch of blocks is a batch of masked attention products.  The chance of a target is that of
its group of ``MEMBERS`` targets times its chance within the group, so a position asks for one group's members
only.  Parameters are learned by Adam, on random blocks (``train``) or on all blocks of texts one after the
other (``Learner``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 16
WIDTH = 16
HIDDEN = 32
MEMBERS = 16
BATCH = 64
STEPS = 1200
RATE = 6e-3

Arrays = dict[str, np.ndarray]


def blocks_of(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Streams of the given lengths as blocks: number of blocks, place of each position (flat), and which
    blocks begin a stream."""
    counts = -(-lengths // BLOCK)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.zeros(int(counts.sum()), bool)
    first[starts[counts > 0]] = True
    return len(first), np.repeat(starts * BLOCK, lengths) + within, first


def _mask() -> np.ndarray:
    query, key = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
    return np.where(key <= query + BLOCK, 0.0, -1e9).astype(np.float32)


_MASK = _mask()
_AGO = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_SCALE = np.float32(WIDTH ** 0.5)


def keep_freed(size: int = 1 << 24) -> None:
    """Freeing one large array makes glibc hold on to that much: else every step's arrays are given back and their pages made anew."""
    np.empty(size, np.uint8)


def _largest(rows: np.ndarray) -> np.ndarray:
    """Largest value of every row, by columns, as rows are short."""
    return np.ascontiguousarray(rows.T).max(axis=0)[:, None]


def _chances(z: np.ndarray) -> np.ndarray:
    """Softmax of every row, in place."""
    z -= _largest(z)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _rows_summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of every number below ``size``."""
    return np.stack([np.bincount(at, column, size) for column in np.ascontiguousarray(rows.T)], axis=1)


@dataclass
class Attention:
    """All parameters side by side, and the shape of each."""
    flat: np.ndarray
    shapes: dict[str, tuple[int, ...]]

    @classmethod
    def new(cls, symbols: int, targets: int, seed: int = 5) -> Attention:
        rng = np.random.default_rng(seed)
        groups = -(-targets // MEMBERS)
        top = HIDDEN + 2 * WIDTH
        kinds = {
            "embed": ((3, symbols, WIDTH), 0.3), "query": ((WIDTH, WIDTH), WIDTH ** -0.5),
            "key": ((WIDTH, WIDTH), WIDTH ** -0.5), "value": ((WIDTH, WIDTH), WIDTH ** -0.5),
            "bias": ((2 * BLOCK,), 0), "up": ((2 * WIDTH, HIDDEN), (2 * WIDTH) ** -0.5),
            "group": ((top, groups), 0.05), "member": ((groups, top, MEMBERS), 0.05),
            "prior": ((groups,), 0), "inner": ((groups, MEMBERS), 0)}
        flat = np.concatenate([(rng.standard_normal(shape) * scale).astype(np.float32).ravel() for shape, scale in kinds.values()])
        out = cls(flat, {name: shape for name, (shape, _) in kinds.items()})
        out.set_prior(np.ones(targets))
        return out

    def view(self, flat: np.ndarray) -> Arrays:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    @property
    def weights(self) -> Arrays:
        return self.view(self.flat)

    def set_prior(self, share: np.ndarray) -> None:
        """Chances of the targets, whatever comes before."""
        w = self.weights
        whole = np.zeros(w["inner"].size)
        whole[:len(share)] = share / share.sum()
        whole = whole.reshape(w["inner"].shape)
        w["prior"][:] = np.log(whole.sum(axis=1))
        w["inner"][:] = np.log(np.maximum(whole / whole.sum(axis=1, keepdims=True), 1e-30))

    def vectors(self, symbols: np.ndarray) -> np.ndarray:
        """Vectors of words given by three symbols each."""
        embed = self.weights["embed"]
        return embed[0][symbols[..., 0]] + embed[1][symbols[..., 1]] + embed[2][symbols[..., 2]]

    def _attend(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """``x``: vectors of a block that is only read, and of those after it, which ``first`` is about."""
        w = self.weights
        q, k, v = x[1:] @ (w["query"] / _SCALE), x @ w["key"], x @ w["value"]
        k, v = (np.concatenate([y[:-1], y[1:]], axis=1) for y in (k, v))
        s = q @ k.transpose(0, 2, 1)
        s += _MASK + np.where(_AGO >= 0, w["bias"][np.maximum(_AGO, 0)], 0)
        s[first, :, :BLOCK] = -1e9
        s -= _largest(s.reshape(-1, 2 * BLOCK)).reshape(-1, BLOCK, 1)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        h = np.concatenate([x[1:], s @ v], axis=2).reshape(-1, 2 * WIDTH)
        up = np.maximum(h @ w["up"], 0)
        return q, k, v, s, h, np.concatenate([up, h], axis=1)

    def _output(self, top: np.ndarray, target: np.ndarray) -> tuple:
        """Chances of the groups; order of the positions by their target's group, where each begins in it, and in
        this order the chances within the group; and the logarithm of every target's chance."""
        w = self.weights
        group, member = np.divmod(target, MEMBERS)
        outer = _chances(top @ w["group"] + w["prior"])
        order = np.argsort(group.astype(np.int16), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(w["prior"]) + 1))
        sorted_ = top[order]
        inner = np.empty((len(top), MEMBERS), np.float32)
        for g in range(len(w["prior"])):
            a, b = bounds[g], bounds[g + 1]
            if a < b:
                inner[a:b] = sorted_[a:b] @ w["member"][g] + w["inner"][g]
        _chances(inner)
        chance = outer[np.arange(len(top)), group]
        chance[order] *= inner[np.arange(len(top)), member[order]]
        return outer, order, bounds, sorted_, inner, np.log(np.maximum(chance, 1e-30))

    def chances(self, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of each position's target, in blocks given by vectors, after one that is only read."""
        return self._output(self._attend(x, first)[-1], target)[-1]

    def gradients(self, own: np.ndarray, first: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of the chance of every target that isn't negative, and the gradient of their mean loss.

        ``own``: symbols of a block that is only read, and of those after it.
        """
        w, x = self.weights, self.vectors(own)
        q, k, v, s, h, top = self._attend(x, first)
        flat = target.ravel()
        at = np.flatnonzero(flat >= 0)
        outer, order, bounds, sorted_, inner, found = self._output(top[at], flat[at])
        flat_out = np.zeros_like(self.flat)
        out = self.view(flat_out)
        group, member = np.divmod(flat[at], MEMBERS)
        rows, n = np.arange(len(at)), np.float32(max(1, len(at)))
        outer[rows, group] -= 1
        outer /= n
        inner[rows, member[order]] -= 1
        inner /= n
        out["group"][:], out["prior"][:] = top[at].T @ outer, outer.sum(axis=0)
        g_sorted = np.empty_like(sorted_)
        for g in range(len(w["prior"])):
            a, b = bounds[g], bounds[g + 1]
            if a < b:
                out["member"][g], out["inner"][g] = sorted_[a:b].T @ inner[a:b], inner[a:b].sum(axis=0)
                g_sorted[a:b] = inner[a:b] @ w["member"][g].T
        g_found = outer @ w["group"].T
        g_found[order] += g_sorted
        g_top = np.zeros_like(top)
        g_top[at] = g_found
        g_up = g_top[:, :HIDDEN] * (top[:, :HIDDEN] > 0)
        out["up"][:] = h.T @ g_up
        g_h = (g_top[:, HIDDEN:] + g_up @ w["up"].T).reshape(len(first), BLOCK, 2 * WIDTH)
        g_a = g_h[:, :, WIDTH:]
        g_s = g_a @ v.transpose(0, 2, 1)
        g_v = s.transpose(0, 2, 1) @ g_a
        g_s -= (g_s * s).sum(axis=2, keepdims=True)
        g_s *= s
        out["bias"][:] = np.bincount(np.maximum(_AGO, 0).ravel(), np.where(_AGO >= 0, g_s.sum(axis=0), 0).ravel(), 2 * BLOCK)
        g_q, g_k = g_s @ k, g_s.transpose(0, 2, 1) @ q
        g_x = np.zeros_like(x)
        g_x[1:] = g_h[:, :, :WIDTH] + g_q @ (w["query"] / _SCALE).T
        out["query"][:] = x[1:].reshape(-1, WIDTH).T @ g_q.reshape(-1, WIDTH) / _SCALE
        for name, g_both in (("key", g_k), ("value", g_v)):
            g_each = np.zeros_like(x)
            g_each[:-1] = g_both[:, :BLOCK]
            g_each[1:] += g_both[:, BLOCK:]
            out[name][:] = x.reshape(-1, WIDTH).T @ g_each.reshape(-1, WIDTH)
            g_x += g_each @ w[name].T
        for i in range(3):
            out["embed"][i] = _rows_summed(own[..., i].ravel(), g_x.reshape(-1, WIDTH), self.shapes["embed"][1])
        return found, flat_out

    def train(self, blocks: np.ndarray, first: np.ndarray, target: np.ndarray, steps: int = STEPS,
              seed: int = 6) -> list[float]:
        """Adam over random runs of blocks, ``BATCH`` blocks a step; gives the losses."""
        rng, learner, losses, size = np.random.default_rng(seed), Learner(self), [], min(8, len(blocks))
        for step in range(steps if len(blocks) else 0):
            at = rng.integers(0, len(blocks) - size + 1, BATCH // size)[:, None] + np.arange(size)
            read = np.concatenate([np.maximum(at[:, :1] - 1, 0), at], axis=1).ravel()
            # The block before each run is only read: what it would predict doesn't count.
            idle = np.arange(len(read)) % (size + 1) == 0
            aims = np.where(idle[:, None], -1, target[read])
            rate = RATE * min(1.0, (step + 1) / 50) * (0.05 + 0.95 * (1 - step / steps))
            found = learner.step(blocks[read], (first[read] | idle)[1:], aims[1:], rate)
            losses.append(-float(found.mean()) if len(found) else 0.0)
        return losses


class Learner:
    """Adam's state beside a network."""

    def __init__(self, network: Attention) -> None:
        keep_freed()
        self.network, self.steps = network, 0
        self.mean, self.square = np.zeros_like(network.flat), np.zeros_like(network.flat)

    def step(self, own: np.ndarray, first: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
        """One step; gives the logarithms of the targets' chances before it."""
        found, g = self.network.gradients(own, first, target)
        self.steps += 1
        self.mean += np.float32(0.1) * (g - self.mean)
        np.multiply(g, g, out=g)
        self.square += np.float32(0.01) * (g - self.square)
        size = np.sqrt(self.square / np.float32(1 - 0.99 ** self.steps))
        size += np.float32(1e-8)
        np.divide(self.mean, size, out=size)
        size *= np.float32(rate / (1 - 0.9 ** self.steps))
        self.network.flat -= size
        return found
