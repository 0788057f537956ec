"""Recurrent cells in numpy: batched forward passes, back-propagation through time, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Adam:
    """Updates a dictionary of arrays in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, B, h) of a GRU over projected inputs x (T, B, 3h: update, reset, candidate); masked steps keep the state."""
    steps, b, h3 = x.shape
    h = h3 // 3
    state, out, tape = np.zeros((b, h), x.dtype), np.empty((steps, b, h), x.dtype), []
    for t in range(steps):
        hu = state @ u
        zr = sigmoid(x[t, :, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[t, :, 2 * h :] + r * hu[:, 2 * h :])
        new = n + z * (state - n)
        m = mask[t][:, None]
        if keep:
            tape.append((state, z, r, n, hu[:, 2 * h :], m))
        state = np.where(m, new, state)
        out[t] = state
    return out, tape


def gru_back(dout: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dx, du) from the gradients (T, B, h) of the states."""
    steps, b, h = dout.shape
    dx, du, dh = np.empty((steps, b, 3 * h), dout.dtype), np.zeros_like(u), np.zeros((b, h), dout.dtype)
    for t in range(steps - 1, -1, -1):
        prev, z, r, n, hn, m = tape[t]
        dh = dh + dout[t]
        d = np.where(m, dh, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (prev - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dn), axis=1)
        dhu = np.concatenate((dz, dr, dn * r), axis=1)
        du += prev.T @ dhu
        dh = np.where(m, d * z + dhu @ u.T, dh)
    return dx, du


def lstm(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, B, h) of an LSTM over projected inputs x (T, B, 4h: input, forget, output, cell)."""
    steps, b, h4 = x.shape
    h = h4 // 4
    state, cell, out, tape = np.zeros((b, h), x.dtype), np.zeros((b, h), x.dtype), np.empty((steps, b, h), x.dtype), []
    for t in range(steps):
        g = x[t] + state @ u
        ifo, c = sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
        i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
        m = mask[t][:, None]
        new_cell = np.where(m, f * cell + i * c, cell)
        tc = np.tanh(new_cell)
        new = np.where(m, o * tc, state)
        if keep:
            tape.append((state, cell, i, f, o, c, tc, m))
        state, cell = new, new_cell
        out[t] = state
    return out, tape


def lstm_back(dout: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dx, du) from the gradients (T, B, h) of the states."""
    steps, b, h = dout.shape
    dx, du = np.empty((steps, b, 4 * h), dout.dtype), np.zeros_like(u)
    dh, dc = np.zeros((b, h), dout.dtype), np.zeros((b, h), dout.dtype)
    for t in range(steps - 1, -1, -1):
        prev, prev_cell, i, f, o, c, tc, m = tape[t]
        dh = dh + dout[t]
        d = np.where(m, dh, 0)
        inner = np.where(m, dc + d * o * (1 - tc * tc), 0)
        g = np.concatenate((inner * c * i * (1 - i), inner * prev_cell * f * (1 - f), d * tc * o * (1 - o), inner * i * (1 - c * c)), axis=1)
        dx[t] = g
        du += prev.T @ g
        dh = np.where(m, g @ u.T, dh)
        dc = np.where(m, inner * f, dc)
    return dx, du
