"""Dense layers, losses and learning-rate policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradloom.functions.shapes import let


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda total, term: total + term)


def dense(x: Column, weight_rows: Column, bias: Column) -> Column:
    """`y = W x + b` with `W` as `array<array<double>>`, one inner array per output."""
    return let(x, lambda once: F.zip_with(weight_rows, bias, lambda w, b: dot(once, w) + b))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def softmax(z: Column) -> Column:
    def normalise(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda total: F.transform(e, lambda x: x / total))

    shifted = let(z, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(shifted, normalise)


def argmax(v: Column) -> Column:
    """Index of the largest element, the first one among equals."""
    return let(v, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def softmax_loss(z: Column, label: Column) -> Column:
    """`-log softmax(z)[label]`, computed without underflow."""
    def loss(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.log(
            F.aggregate(v, F.lit(0.0), lambda t, x: t + F.exp(x - top))) + top - F.get(v, label))

    return let(z, loss)


def learning_rate(step: Column, policy: str, base_lr: float, gamma: float = 0.1, step_size: int = 1,
                  batch: int = 1, decay_rate: float = 1.0, decay_samples: int = 1) -> Column:
    """Learning rate at a 0-based step.

    `fixed`; `step`: times `gamma` every `step_size` steps; `exponential`: times `decay_rate` for every whole
    `decay_samples` samples seen.
    """
    if policy == "fixed":
        return F.lit(float(base_lr))
    if policy == "step":
        return F.lit(float(base_lr)) * F.pow(F.lit(float(gamma)), F.floor(step / step_size))
    if policy == "exponential":
        return F.lit(float(base_lr)) * F.pow(F.lit(float(decay_rate)), F.floor(step * batch / decay_samples))
    raise ValueError(f"unknown learning-rate policy {policy}")


def percent(share: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.format_string("%.2f", share * 100)
