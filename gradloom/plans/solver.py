"""Stochastic gradient descent with momentum, weight decay and a learning-rate policy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gradloom.plans.batches import Blobs
from gradloom.plans.net import Net


@dataclass(frozen=True)
class Solver:
    """`scaled`: v = m v - lr (g + decay w), w += v. `plain`: v = m v + g, w -= lr v. They agree at a constant rate.

    `momentum_state` says what happens to v between rounds: `average` with the weights, `local` to each worker, or
    `reset`.
    """

    base_lr: float = 0.01
    momentum: float = 0.0
    decay: float = 0.0
    policy: str = "fixed"
    gamma: float = 0.1
    step_size: int = 1
    decay_rate: float = 1.0
    decay_samples: int = 1
    form: str = "scaled"
    momentum_state: str = "average"

    def __post_init__(self):
        if self.form not in ("scaled", "plain") or self.momentum_state not in ("average", "local", "reset"):
            raise ValueError(f"unknown momentum form or state: {self.form}, {self.momentum_state}")

    def rate(self, step: int, batch: int = 1) -> float:
        if self.policy == "fixed":
            return self.base_lr
        if self.policy == "step":
            return self.base_lr * self.gamma ** (step // self.step_size)
        if self.policy == "exponential":
            return self.base_lr * self.decay_rate ** (step * batch // self.decay_samples)
        raise ValueError(f"unknown learning-rate policy {self.policy}")

    def update(self, net: Net, weights: Blobs, grads: Blobs, velocity: Blobs, step: int, batch: int) -> None:
        """One step in place on `weights` and `velocity`."""
        lr = self.rate(step, batch)
        for p in net.params():
            name = p.layer, p.blob
            g = grads[name] + self.decay * p.decay_mult * weights[name]
            v = velocity.get(name, np.zeros_like(g))
            if self.form == "scaled":
                velocity[name] = self.momentum * v - lr * p.lr_mult * g
                weights[name] = weights[name] + velocity[name]
            else:
                velocity[name] = self.momentum * v + g
                weights[name] = weights[name] - lr * p.lr_mult * velocity[name]
