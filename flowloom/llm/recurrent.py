"""A bidirectional gated recurrent layer in NumPy, with its gradients.

Arrays are laid out feature by feature (``[..., feature, column]``), columns
being independent sequences.  Direction 0 reads forwards, direction 1 backwards.
Gates are stacked as reset, update, candidate.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function by tanh, which does not overflow."""
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Recurrent weights of both directions: ``[2, 3 * hidden, hidden]``."""

    def __init__(self, hidden: int, draw: np.random.Generator):
        self.hidden = hidden
        self.weights = draw.normal(0, 0.5 / np.sqrt(hidden), (2, 3 * hidden, hidden))
        self.weights = self.weights.astype(np.float32)

    def step(self, gates: np.ndarray, state: np.ndarray):
        """One step; ``gates`` is the input part ``[2, 3H, B]``."""
        size = self.hidden
        inner = np.matmul(self.weights, state)
        opens = sigmoid(gates[:, : 2 * size] + inner[:, : 2 * size])
        reset, update = opens[:, :size], opens[:, size:]
        fresh = np.tanh(gates[:, 2 * size :] + reset * inner[:, 2 * size :])
        return fresh + update * (state - fresh), (state, inner, reset, update, fresh)

    def forward(self, gates: np.ndarray, mask: np.ndarray):
        """All states ``[T, 2, H, B]`` in reading order of each direction.

        ``gates`` is ``[T, 2, 3H, B]`` and ``mask`` ``[T, 2, 1, B]``, both in
        reading order; a masked step keeps the state.
        """
        state = np.zeros((2, self.hidden, gates.shape[-1]), np.float32)
        states, saved = [], []
        for t in range(len(gates)):
            moved, parts = self.step(gates[t], state)
            state = state + mask[t] * (moved - state)
            states.append(state)
            saved.append(parts)
        return np.array(states), saved

    def backward(self, slopes: np.ndarray, mask: np.ndarray, saved: list):
        """Slopes of the input gates ``[T, 2, 3H, B]`` and of the weights."""
        size = self.hidden
        by_gates = np.empty((len(saved), 2, 3 * size, slopes.shape[-1]), np.float32)
        by_weights = np.zeros_like(self.weights)
        later = np.zeros_like(slopes[0])
        turned = self.weights.transpose(0, 2, 1)
        for t in range(len(saved) - 1, -1, -1):
            state, inner, reset, update, fresh = saved[t]
            total = slopes[t] + later
            own = total * mask[t]
            by_fresh = own * (1 - update) * (1 - fresh * fresh)
            by_update = own * (state - fresh) * update * (1 - update)
            by_reset = by_fresh * inner[:, 2 * size :] * reset * (1 - reset)
            out = by_gates[t]
            out[:, :size], out[:, size : 2 * size], out[:, 2 * size :] = by_reset, by_update, by_fresh
            recurrent = out.copy()
            recurrent[:, 2 * size :] *= reset
            by_weights += np.matmul(recurrent, state.transpose(0, 2, 1))
            later = total - own + own * update + np.matmul(turned, recurrent)
        return by_gates, by_weights


class Adam:
    """Adam updates for a dictionary of arrays, in place."""

    def __init__(self, arrays: dict[str, np.ndarray], rate: float):
        self.arrays, self.rate, self.count = arrays, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in arrays.items()}
        self.second = {k: np.zeros_like(v) for k, v in arrays.items()}

    def step(self, slopes: dict[str, np.ndarray], scale: float = 1.0) -> None:
        """One update with slopes clipped to a common norm of 1."""
        self.count += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in slopes.values())))
        shrink = min(1.0, 1.0 / max(norm, 1e-12))
        fix1, fix2 = 1 - 0.9**self.count, 1 - 0.999**self.count
        for name, slope in slopes.items():
            slope = slope * shrink
            first, second = self.first[name], self.second[name]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            self.arrays[name] -= scale * self.rate * (first / fix1) / (np.sqrt(second / fix2) + 1e-8)
