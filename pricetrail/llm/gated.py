"""Bidirectional gated recurrent layers with attention pooling, forward and backward, in numpy.

Sequences are arrays (steps, rows, width); a mask (steps, rows) is 1 at real steps, which come first. Training sorts the rows by length, so
that each step works on the rows that are that long. Scoring runs the forward direction on past the end, because attention never looks
there, and holds the backward one at zero until it meets the last real step.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


def new_layer(rng: np.random.Generator, width: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    """Weights: per direction the input W, recurrence U and bias b of the update, reset and candidate gates; the attention v."""
    make = lambda *size: (rng.standard_normal(size) / np.sqrt(size[0])).astype(np.float32)
    out = {f"{name}.v": make(2 * hidden)}
    for side in "fb":
        out |= {f"{name}.W{side}": make(width, 3 * hidden), f"{name}.U{side}": make(hidden, 3 * hidden),
                f"{name}.b{side}": np.zeros(3 * hidden, np.float32)}
    return out


def step(gates: np.ndarray, h: np.ndarray, U: np.ndarray):
    """One step of the unit: the new state, and what the backward pass needs."""
    H = h.shape[1]
    hu = h @ U
    zr = sigmoid(gates[:, : 2 * H] + hu[:, : 2 * H])
    z, r, q = zr[:, :H], zr[:, H:], hu[:, 2 * H :]
    n = tanh(gates[:, 2 * H :] + r * q)
    return n + z * (h - n), (h, z, r, q, n)


def run(gates: np.ndarray, U: np.ndarray, counts: list[int]):
    """States of one direction; step t has rows [:counts[t]], the longest sequences first. Rows start from zero when they appear."""
    out, kept = np.zeros((*gates.shape[:2], U.shape[0]), U.dtype), []
    h = np.zeros((counts[0], U.shape[0]), U.dtype)
    for t, n in enumerate(counts):
        h = h[:n] if n <= len(h) else np.concatenate([h, np.zeros((n - len(h), U.shape[0]), U.dtype)])
        h, cache = step(gates[t, :n], h, U)
        out[t, :n] = h
        kept.append(cache)
    return out, kept


def run_back(grad: np.ndarray, kept: list, U: np.ndarray):
    """Gradients of the gates' inputs and of U, from those of the states."""
    H = U.shape[0]
    carry, dU, out = np.zeros((0, H), U.dtype), np.zeros_like(U), np.zeros((*grad.shape[:2], 3 * H), U.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, q, n = kept[t]
        d = grad[t, : len(h)].copy()
        both = min(len(d), len(carry))
        d[:both] += carry[:both]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        dU += h.T @ dhu
        carry = d * z + dhu @ U.T
        out[t, : len(h), : 2 * H] = dhu[:, : 2 * H]
        out[t, : len(h), 2 * H :] = dn
    return out, dU


def pool(p: dict, name: str, x: np.ndarray, mask: np.ndarray):
    """Both directions over x, pooled by attention: (rows, 2 * hidden)."""
    order = np.argsort(-mask.sum(axis=0), kind="stable")
    x, mask = x[:, order], mask[:, order]
    counts = mask.sum(axis=1).astype(int).tolist()
    hf, cf = run(x @ p[f"{name}.Wf"] + p[f"{name}.bf"], p[f"{name}.Uf"], counts)
    hb, cb = run(x[::-1] @ p[f"{name}.Wb"] + p[f"{name}.bb"], p[f"{name}.Ub"], counts[::-1])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    e = np.where(mask > 0, h @ p[f"{name}.v"], np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    a = a / a.sum(axis=0)
    out = np.empty((len(order), h.shape[2]), h.dtype)
    out[order] = np.einsum("tn,tnh->nh", a, h)
    return out, (order, x, h, a, cf, cb)


def pool_back(p: dict, name: str, grad: np.ndarray, cache) -> tuple[np.ndarray, dict]:
    order, x, h, a, cf, cb = cache
    grad = grad[order]
    da = np.einsum("tnh,nh->tn", h, grad)
    de = a * (da - (a * da).sum(axis=0))
    dh = a[:, :, None] * grad[None] + de[:, :, None] * p[f"{name}.v"]
    H, out = h.shape[2] // 2, {f"{name}.v": np.tensordot(de, h, ((0, 1), (0, 1)))}
    gf, out[f"{name}.Uf"] = run_back(dh[:, :, :H], cf, p[f"{name}.Uf"])
    gb, out[f"{name}.Ub"] = run_back(dh[::-1, :, H:], cb, p[f"{name}.Ub"])
    gb = gb[::-1]
    for side, g in (("f", gf), ("b", gb)):
        out[f"{name}.W{side}"] = np.tensordot(x, g, ((0, 1), (0, 1)))
        out[f"{name}.b{side}"] = g.sum(axis=(0, 1))
    dx = np.empty_like(x)
    dx[:, order] = gf @ p[f"{name}.Wf"].T + gb @ p[f"{name}.Wb"].T
    return dx, out


def scatter(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their number in ``at``."""
    return np.stack([np.bincount(at, column, size) for column in np.ascontiguousarray(values.T)], axis=1).astype(values.dtype)


def states(table: np.ndarray, U: np.ndarray, at: np.ndarray, back: bool, look: np.ndarray | None = None) -> np.ndarray:
    """States (steps, rows, hidden) of one direction where inputs come from a table of gate inputs, without what a backward
    pass needs. ``at`` (steps, rows) names table rows, 0 for no input. With ``look``, its products with the states are returned instead."""
    H = U.shape[0]
    # signs and the factor of tanh go into the tables, so that each gate is one exponential and one reciprocal
    gate, cand = np.ascontiguousarray(-table[:, : 2 * H]), np.ascontiguousarray(-2 * table[:, 2 * H :])
    Ug, Uc = np.ascontiguousarray(-U[:, : 2 * H]), np.ascontiguousarray(-2 * U[:, 2 * H :])
    h = np.zeros((at.shape[1], H), np.float32)
    out = np.empty((*at.shape, H if look is None else look.shape[1]), np.float32)
    for t in range(len(at) - 1, -1, -1) if back else range(len(at)):
        zr = gate.take(at[t], axis=0)
        zr += h @ Ug
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = h @ Uc
        n *= zr[:, H:]
        n += cand.take(at[t], axis=0)
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        h = h - n
        h *= zr[:, :H]
        h += n
        if back:
            h *= (at[t] > 0)[:, None]
        out[t] = h if look is None else h @ look
    return out


class Adam:
    """Adam with a pull of all weights towards zero."""

    def __init__(self, p: dict, rate: float, decay: float = 0.05):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, grads: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.p[k] *= np.float32(1 - self.rate * self.decay)
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)
