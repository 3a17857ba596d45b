"""A gated recurrent cell and Adam in numpy."""

from __future__ import annotations

import heapq

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def step(xg: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One step of a batch: xg (B, 3H) are the input's parts of reset, update and candidate; h (B, H); u (H, 3H)."""
    k = h.shape[1]
    g = h @ u
    rz = sigmoid(xg[:, : 2 * k] + g[:, : 2 * k])
    n = np.tanh(xg[:, 2 * k :] + rz[:, :k] * g[:, 2 * k :])
    return n + rz[:, k:] * (h - n)


def forward(xg: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """xg (T, B, 3H) -> states (T, B, H) and what backward needs."""
    k, out, kept = h.shape[1], np.empty((*xg.shape[:2], h.shape[1]), np.float32), []
    for t in range(len(xg)):
        g = h @ u
        rz = sigmoid(xg[t, :, : 2 * k] + g[:, : 2 * k])
        r, z = rz[:, :k], rz[:, k:]
        n = np.tanh(xg[t, :, 2 * k :] + r * g[:, 2 * k :])
        kept.append((h, r, z, n, g[:, 2 * k :]))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def backward(dout: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs (T, B, 3H) and of u, by backpropagation through all T steps."""
    k = u.shape[0]
    dx, du, dh = np.empty((*dout.shape[:2], 3 * k), np.float32), np.zeros_like(u), np.zeros_like(dout[0])
    for t in range(len(dout) - 1, -1, -1):
        h, r, z, n, gn = kept[t]
        dh = dh + dout[t]
        da = dh * (1 - z) * (1 - n * n)
        dr = da * gn * r * (1 - r)
        dz = dh * (h - n) * z * (1 - z)
        dg = np.concatenate([dr, dz, da * r], 1)
        dx[t, :, : 2 * k], dx[t, :, 2 * k :] = dg[:, : 2 * k], da
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return dx, du


def lanes_step(xg: np.ndarray, h: np.ndarray, down: np.ndarray, gates: np.ndarray, gn: np.ndarray, out: np.ndarray) -> None:
    """step with the lanes last, so that a gate is one stretch of memory: xg (3H, B), h (H, B), down (3H, H) is u turned. Writes gates, the candidate's part gn, and out.

    The candidate's tanh(x) is made as 2 / (1 + exp(-2x)) - 1, for which numpy takes half the time.
    """
    k = len(h)
    g, rz, n = down @ h, gates[: 2 * k], gates[2 * k :]
    gn[:] = g[2 * k :]
    np.add(xg[: 2 * k], g[: 2 * k], out=rz)
    np.negative(rz, out=rz)
    np.exp(rz, out=rz)
    rz += 1
    np.reciprocal(rz, out=rz)
    np.multiply(rz[:k], gn, out=n)
    n += xg[2 * k :]
    n *= -2
    np.minimum(n, 80, out=n)
    np.exp(n, out=n)
    n += 1
    np.divide(2, n, out=n)
    n -= 1
    np.subtract(h, n, out=out)
    out *= rz[k:]
    out += n


def lanes_forward(xg: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """forward with the lanes last: xg (T, 3H, B), h (H, B) -> states (T, H, B) and what lanes_backward needs."""
    long, down = len(xg), np.ascontiguousarray(u.T)
    states, gates, gn = np.empty((long + 1, *h.shape), np.float32), np.empty(xg.shape, np.float32), np.empty((long, *h.shape), np.float32)
    states[0] = h
    for t in range(long):
        lanes_step(xg[t], states[t], down, gates[t], gn[t], states[t + 1])
    return states[1:], (states[:-1], gates, gn)


def lanes_backward(dout: np.ndarray, kept: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """backward with the lanes last: gradients of the gates' inputs (T, 3H, B) and of u. All that does not hang on later steps is made at once."""
    (h, gates, gn), k = kept, u.shape[0]
    r, z, n = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
    still = 1 - z
    through, turned = still * (1 - n * n), gn * r * (1 - r)
    still *= z
    still *= h - n
    dg, da, dh = np.empty(gates.shape, np.float32), np.empty(h.shape, np.float32), np.zeros(h.shape[1:], np.float32)
    for t in range(len(dout) - 1, -1, -1):
        dh += dout[t]
        np.multiply(dh, through[t], out=da[t])
        np.multiply(da[t], turned[t], out=dg[t, :k])
        np.multiply(dh, still[t], out=dg[t, k : 2 * k])
        np.multiply(da[t], r[t], out=dg[t, 2 * k :])
        dh *= z[t]
        dh += u @ dg[t]
    du = np.matmul(h, dg.transpose(0, 2, 1)).sum(0)
    dg[:, 2 * k :] = da
    return dg, du


def summed_rows(index: np.ndarray, grads: np.ndarray, n: int, few: int = 8) -> np.ndarray:
    """grads (N, D) added up by index (N,) into (n, D). Those of up to `few` rows are added side by side, the first of each, the second, and so on."""
    order = np.argsort(index.astype(np.uint16) if n <= 1 << 16 else index, kind="stable")
    index, grads, out = index[order], grads[order], np.zeros((n, grads.shape[1]), np.float32)
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.zeros(0, np.int64)
    kinds, times = index[first], np.diff(np.append(first, len(index)))
    for i in np.flatnonzero(times > few):
        out[kinds[i]] = grads[first[i] : first[i] + times[i]].sum(0)
    rare = np.flatnonzero(times <= few)
    for j in range(few):
        rare = rare[times[rare] > j]
        out[kinds[rare]] += grads[first[rare] + j]
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9)) if norm > 1.0 else 1.0
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            self.params[k] -= self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-6)


def dealt(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of `sizes` steps -> their order, lane after lane, and each lane's length, the longest lane first."""
    lanes = max(1, min(lanes, len(sizes)))
    load, own = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable"):  # the longest first, each to the emptiest lane
        used, j = heapq.heappop(load)
        own[j].append(i)
        heapq.heappush(load, (used + int(sizes[i]), j))
    load.sort(key=lambda x: (-x[0], x[1]))
    return np.array([i for _, j in load for i in own[j]], np.int64), np.array([used for used, _ in load], np.int64)
