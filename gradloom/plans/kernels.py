"""Forward and backward passes of one minibatch in NumPy. Tasks call these; Spark decides which rows they get."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from gradloom.plans.batches import Blobs
from gradloom.plans.net import Layer, Net


def _padded(x: np.ndarray, layer: Layer, fill: float) -> tuple[np.ndarray, tuple[int, int], tuple]:
    """The padded input, the output size and the padding."""
    size, pads = layer.window(*x.shape[2:])
    return np.pad(x, ((0, 0), (0, 0), *pads), constant_values=fill), size, pads


def _at(grid: np.ndarray, layer: Layer, i: int, j: int, size: tuple[int, int]) -> np.ndarray:
    """The values that kernel position (i, j) meets, one per output pixel."""
    rows, cols = (slice(at, at + layer.stride * n, layer.stride) for at, n in zip((i, j), size))
    return grid[:, :, rows, cols]


def _fold(pieces, shape: tuple[int, ...], layer: Layer, pads: tuple) -> np.ndarray:
    """Add each kernel position's (n, channels, out_height, out_width) piece back onto the input grid."""
    height, width = shape[2] + sum(pads[0]), shape[3] + sum(pads[1])
    total = None
    for i, j, piece in pieces:
        if total is None:
            total = np.zeros((*piece.shape[:2], height, width), piece.dtype)
        _at(total, layer, i, j, piece.shape[2:])[...] += piece
    return total[:, :, pads[0][0]:pads[0][0] + shape[2], pads[1][0]:pads[1][0] + shape[3]]


def _positions(layer: Layer):
    return [(i, j) for i in range(layer.kernel) for j in range(layer.kernel)]


def dense_forward(layer, x, w, b):
    flat = x.reshape(len(x), -1)
    return flat @ w.T + b, (flat, x.shape)


def dense_backward(layer, g, cache, w, into_input=True):
    flat, shape = cache
    return (g @ w).reshape(shape) if into_input else None, g.T @ flat, g.sum(axis=0)


def conv_forward(layer, x, w, b):
    padded, (height, width), pads = _padded(x, layer, 0.0)
    windows = sliding_window_view(padded, (layer.kernel, layer.kernel), axis=(2, 3))
    windows = windows[:, :, ::layer.stride, ::layer.stride][:, :, :height, :width]
    y = np.tensordot(windows, w, axes=((1, 4, 5), (1, 2, 3)))
    return np.moveaxis(y + b, 3, 1), (windows, pads, x.shape)


def conv_backward(layer, g, cache, w, into_input=True):
    windows, pads, shape = cache
    dw, db = np.tensordot(g, windows, axes=((0, 2, 3), (0, 2, 3))), g.sum(axis=(0, 2, 3))
    if not into_input:
        return None, dw, db
    pieces = ((i, j, np.moveaxis(np.tensordot(g, w[:, :, i, j], axes=(1, 0)), 3, 1)) for i, j in _positions(layer))
    return _fold(pieces, shape, layer, pads), dw, db


def pool_forward(layer, x):
    largest = layer.pool == "max"
    padded, size, pads = _padded(x, layer, -np.inf if largest else 0.0)
    if not largest:
        inside, _, _ = _padded(np.ones((1, 1, *x.shape[2:]), x.dtype), layer, 0.0)
        count = sum(_at(inside, layer, i, j, size) for i, j in _positions(layer))
        return sum(_at(padded, layer, i, j, size) for i, j in _positions(layer)) / count, (count, pads, x.shape)
    best, where = None, None
    for at, (i, j) in enumerate(_positions(layer)):
        value = _at(padded, layer, i, j, size)
        if best is None:
            best, where = value.copy(), np.zeros(value.shape, "i4")
        else:
            better = value > best
            np.copyto(best, value, where=better)
            where[better] = at
    return best, (where, pads, x.shape)


def pool_backward(layer, g, cache):
    state, pads, shape = cache
    if layer.pool == "max":
        pieces = ((i, j, g * (state == i * layer.kernel + j)) for i, j in _positions(layer))
    else:
        pieces = ((i, j, g / state) for i, j in _positions(layer))
    return _fold(pieces, shape, layer, pads)


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward_pass(net: Net, weights: Blobs, inputs: dict[str, np.ndarray], train: bool = False,
                 rng: np.random.Generator | None = None) -> tuple[dict[str, np.ndarray], list]:
    """All blobs by name, and per layer what the backward pass needs. Loss and accuracy hold one value per sample."""
    blobs, caches = dict(inputs), []
    for layer in net.layers:
        x, cache = blobs[layer.bottom[0]], None
        if layer.kind in ("dense", "conv"):
            run = dense_forward if layer.kind == "dense" else conv_forward
            y, cache = run(layer, x, weights[layer.name, 0], weights[layer.name, 1])
        elif layer.kind == "pool":
            y, cache = pool_forward(layer, x)
        elif layer.kind == "relu":
            y, cache = np.maximum(x, 0), x > 0
        elif layer.kind == "dropout":
            cache = (rng.random(x.shape) >= layer.ratio) / (1 - layer.ratio) if train else 1.0
            y = x * np.asarray(cache, x.dtype)
        elif layer.kind == "reshape":
            y, cache = x.reshape(len(x), *(layer.shape or (-1,))), x.shape
        elif layer.kind == "softmax":
            y = probabilities(x)
        elif layer.kind == "accuracy":
            y = (x.argmax(axis=1) == blobs[layer.bottom[1]]).astype(x.dtype)
        else:
            label = blobs[layer.bottom[1]]
            if len(label) and not (0 <= label.min() and label.max() < x.shape[1]):
                raise ValueError(f"label outside 0..{x.shape[1] - 1}")
            top = x.max(axis=1)
            y = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(x)), label]
            cache = (x, label)
        blobs[layer.top] = y
        caches.append(cache)
    return blobs, caches


def backward_pass(net: Net, weights: Blobs, caches: list) -> Blobs:
    """Gradient of the mean loss (with its L2 term) for every parameter blob."""
    inputs = {i.name for i in net.inputs}
    flowing: dict[str, np.ndarray] = {}
    grads: Blobs = {}
    for layer, cache in zip(reversed(net.layers), reversed(caches)):
        if layer.kind == "softmax_loss":
            z, label = cache
            back = probabilities(z)
            back[np.arange(len(z)), label] -= 1
            back /= len(z)
        elif layer.kind in ("softmax", "accuracy") or layer.top not in flowing:
            continue
        else:
            g = flowing.pop(layer.top)
            if layer.kind in ("dense", "conv"):
                run = dense_backward if layer.kind == "dense" else conv_backward
                back, grads[layer.name, 0], grads[layer.name, 1] = run(
                    layer, g, cache, weights[layer.name, 0], layer.bottom[0] not in inputs)
            elif layer.kind == "pool":
                back = pool_backward(layer, g, cache)
            elif layer.kind == "reshape":
                back = g.reshape(cache)
            else:
                back = g * np.asarray(cache, g.dtype)
        source = layer.bottom[0]
        if source in inputs:
            continue
        flowing[source] = flowing[source] + back if source in flowing else back
    for (name, blob), w in weights.items():
        if name in net.l2 and (name, blob) in grads:
            grads[name, blob] = grads[name, blob] + net.l2[name] * w
    return grads


def mean_loss(net: Net, weights: Blobs, blobs: dict[str, np.ndarray]) -> float:
    penalty = sum(net.l2.get(name, 0.0) * float((w * w).sum()) / 2 for (name, _), w in weights.items())
    return float(blobs[net.loss_layer().top].mean()) + penalty
