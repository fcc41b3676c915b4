"""Net descriptions: inputs, layers, parameter blobs and their shapes, all known before a job runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from math import ceil, prod

import numpy as np
from pyspark.sql import Column, types as T


@dataclass(frozen=True)
class Filler:
    """How initial values are drawn: constant, gaussian, truncated (gaussian within two deviations) or xavier."""

    kind: str = "constant"
    value: float = 0.0
    std: float = 1.0


@dataclass(frozen=True)
class Prepare:
    """A batch preparation of one input: rows of `width` raw values and the extra `columns` to the input's shape.

    The table holds the extra columns, or `draw` makes them anew for every pass over the data: expressions of the columns
    that it `reads`, for a given round.
    """

    width: int
    columns: tuple[str, ...]
    run: Callable[..., np.ndarray]
    draw: Callable[[int], Sequence[Column]] | None = None
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Input:
    """A named column with its per-sample shape; `prepare` runs inside the batch, before the first layer."""

    name: str
    shape: tuple[int, ...] = (1,)
    label: bool = False
    prepare: Prepare | None = None


@dataclass(frozen=True)
class Param:
    """One parameter blob of a layer (0 weight, 1 bias) with its learning-rate and decay multipliers."""

    layer: str
    blob: int
    shape: tuple[int, ...]
    filler: Filler
    lr_mult: float = 1.0
    decay_mult: float = 1.0

    @property
    def size(self) -> int:
        return prod(self.shape)


@dataclass(frozen=True)
class Layer:
    kind: str
    name: str
    bottom: tuple[str, ...]
    top: str
    outputs: int = 0
    kernel: int = 1
    stride: int = 1
    pad: int | str = 0
    pool: str = "max"
    ratio: float = 0.5
    shape: tuple[int, ...] = ()
    fillers: tuple[Filler, Filler] = (Filler("xavier"), Filler())
    lr_mult: tuple[float, float] = (1.0, 1.0)
    decay_mult: tuple[float, float] = (1.0, 1.0)

    def window(self, height: int, width: int) -> tuple[tuple[int, int], tuple[tuple[int, int], ...]]:
        """Output (height, width) and the padding ((top, bottom), (left, right)) of a convolution or pooling.

        A number pads both sides; pooling then rounds the output size up, convolution down. `SAME` and `VALID` follow
        the usual meaning.
        """
        sizes, pads = [], []
        for extent in (height, width):
            if self.pad == "SAME":
                out = ceil(extent / self.stride)
                total = max((out - 1) * self.stride + self.kernel - extent, 0)
                before = total // 2
            else:
                before = 0 if self.pad == "VALID" else self.pad
                room = extent + 2 * before - self.kernel
                rounds_up = self.kind == "pool" and self.pad != "VALID"
                out = (ceil(room / self.stride) if rounds_up else room // self.stride) + 1
                if rounds_up and before and (out - 1) * self.stride >= extent + before:
                    out -= 1
            after = max((out - 1) * self.stride + self.kernel - extent - before, 0)
            sizes.append(out)
            pads.append((before, after))
        return tuple(sizes), tuple(pads)


@dataclass(frozen=True)
class Net:
    """A net over named columns. `l2` maps layers to the coefficient of their squared-weight loss term."""

    name: str
    inputs: tuple[Input, ...]
    layers: tuple[Layer, ...]
    l2: dict[str, float] = field(default_factory=dict)
    dtype: str = "float64"

    def columns(self) -> list[str]:
        """All columns the net reads from a table: its inputs and what their preparations need."""
        extra = [c for i in self.inputs if i.prepare for c in (i.prepare.reads if i.prepare.draw else i.prepare.columns)]
        return list(dict.fromkeys([i.name for i in self.inputs] + extra))

    def batch_columns(self) -> list[str]:
        """All columns a batch of the net is made of: those of the table, with drawn ones instead of what they are drawn from."""
        extra = [c for i in self.inputs if i.prepare for c in i.prepare.columns]
        return list(dict.fromkeys([i.name for i in self.inputs] + extra))

    def prepared(self, name: str, prepare: Prepare) -> Net:
        """The same net with a batch preparation of one input."""
        return replace(self, inputs=tuple(replace(i, prepare=prepare) if i.name == name else i for i in self.inputs))

    @property
    def label(self) -> str | None:
        return next((i.name for i in self.inputs if i.label), None)

    def blob_shapes(self) -> dict[str, tuple[int, ...]]:
        """Per-sample shape of every blob; a blob that a later layer overwrites keeps its last shape."""
        return self._infer()[0]

    def params(self) -> list[Param]:
        return self._infer()[1]

    def _infer(self) -> tuple[dict[str, tuple[int, ...]], list[Param]]:
        shapes = {i.name: tuple(i.shape) for i in self.inputs}
        params: list[Param] = []
        for layer in self.layers:
            absent = [b for b in layer.bottom if b not in shapes]
            if absent:
                raise ValueError(f"layer {layer.name} reads unknown blobs {absent}")
            source = shapes[layer.bottom[0]]
            weight = None
            if layer.kind == "dense":
                weight, out = (layer.outputs, prod(source)), (layer.outputs,)
            elif layer.kind == "conv":
                weight = (layer.outputs, source[0], layer.kernel, layer.kernel)
                out = (layer.outputs, *layer.window(*source[1:])[0])
            elif layer.kind == "pool":
                out = (source[0], *layer.window(*source[1:])[0])
            elif layer.kind == "reshape":
                out = layer.shape or (prod(source),)
            elif layer.kind in ("relu", "softmax", "dropout"):
                out = source
            elif layer.kind in ("softmax_loss", "accuracy"):
                out = (1,)
            else:
                raise ValueError(f"unknown layer kind {layer.kind}")
            if weight:
                for blob, shape in enumerate([weight, (layer.outputs,)]):
                    params.append(Param(layer.name, blob, shape, layer.fillers[blob], layer.lr_mult[blob],
                                        layer.decay_mult[blob]))
            shapes[layer.top] = out
        return shapes, params

    def size(self) -> int:
        """Number of parameters: the proven bound of everything that carries weights."""
        return sum(p.size for p in self.params())

    def outputs(self) -> list[str]:
        """Blobs that no other layer reads."""
        read = {b for layer in self.layers for b in layer.bottom if b != layer.top}
        return [t for t in dict.fromkeys(layer.top for layer in self.layers) if t not in read]

    def loss_layer(self) -> Layer:
        return next(layer for layer in self.layers if layer.kind == "softmax_loss")

    def subnet(self, blobs: Sequence[str]) -> Net:
        """The layers and inputs that the given blobs depend on."""
        needed, layers = set(blobs), []
        for layer in reversed(self.layers):
            if layer.top in needed:
                layers.append(layer)
                needed.update(layer.bottom)
        return Net(self.name, tuple(i for i in self.inputs if i.name in needed), tuple(reversed(layers)), self.l2, self.dtype)

    def label_blobs(self) -> set[str]:
        """Blobs that cannot be computed without labels."""
        return {layer.top for layer in self.layers if self.label in layer.bottom}

    def output_schema(self, blobs: Sequence[str] | None = None, element: str = "float") -> T.StructType:
        """One non-null array field per blob; an unknown blob is an error."""
        known = self.blob_shapes()
        unknown = [b for b in blobs or [] if b not in known]
        if unknown:
            raise ValueError(f"net {self.name} has no blob named {', '.join(unknown)}")
        value = T.FloatType() if element == "float" else T.DoubleType()
        return T.StructType([T.StructField(b, T.ArrayType(value), False) for b in blobs or self.outputs()])


def dense(name: str, bottom: str, outputs: int, **options) -> Layer:
    return Layer("dense", name, (bottom,), name, outputs=outputs, **options)


def conv(name: str, bottom: str, outputs: int, kernel: int, **options) -> Layer:
    return Layer("conv", name, (bottom,), name, outputs=outputs, kernel=kernel, **options)


def pool(name: str, bottom: str, method: str, kernel: int, stride: int, pad: int | str = 0) -> Layer:
    return Layer("pool", name, (bottom,), name, pool=method, kernel=kernel, stride=stride, pad=pad)


def relu(name: str, blob: str) -> Layer:
    """In place: the blob keeps its name."""
    return Layer("relu", name, (blob,), blob)


def dropout(name: str, blob: str, ratio: float = 0.5) -> Layer:
    return Layer("dropout", name, (blob,), blob, ratio=ratio)


def softmax(name: str, bottom: str) -> Layer:
    return Layer("softmax", name, (bottom,), name)


def accuracy(name: str, bottom: str, label: str = "label") -> Layer:
    return Layer("accuracy", name, (bottom, label), name)


def softmax_loss(name: str, bottom: str, label: str = "label") -> Layer:
    return Layer("softmax_loss", name, (bottom, label), name)


def softmax_regression(inputs: int, classes: int, data: str = "data", label: str = "label") -> Net:
    """One dense layer with softmax, accuracy and loss."""
    return Net("softmax_regression", (Input(data, (inputs,)), Input(label, label=True)),
               (dense("ip", data, classes), softmax("prob", "ip"), accuracy("accuracy", "ip", label),
                softmax_loss("loss", "ip", label)))


def weights_by_rule(net: Net, value) -> dict[tuple[str, int], np.ndarray]:
    """Driver-side weights from a function of (layer, blob, flat index array); for tests and fixed nets."""
    return {(p.layer, p.blob): np.asarray(value(p.layer, p.blob, np.arange(p.size)), "f8").reshape(p.shape)
            for p in net.params()}
