"""Ready-made nets and run settings."""

from __future__ import annotations

from dataclasses import dataclass

from gradloom.plans.net import (Filler, Input, Net, accuracy, conv, dense, dropout, pool, relu, softmax, softmax_loss)
from gradloom.plans.solver import Solver


@dataclass(frozen=True)
class Run:
    """Batch sizes, steps per round and evaluation interval of a training run.

    `scaled` inputs are pixels to be rescaled; of `raw` images as bytes the mean is subtracted and a crop of the net's size taken
    anew in each round.
    """

    batch: int
    test_batch: int
    tau: int
    eval_every: int
    shuffle: bool
    cached: bool
    scaled: bool = False
    raw: tuple[int, int, int] | None = None


# Layer sizes, fillers, multipliers and run settings of the published nets.
RUNS = {
    "cifar": Run(100, 100, 10, 5, shuffle=True, cached=True),
    "mnist": Run(64, 64, 10, 5, shuffle=True, cached=True, scaled=True),
    "imagenet": Run(256, 256, 50, 10, shuffle=False, cached=True, raw=(3, 256, 256)),
    "imagenet-alexnet": Run(256, 256, 10, 5, shuffle=False, cached=False, raw=(3, 256, 256)),
    "featurize": Run(100, 100, 0, 0, shuffle=True, cached=True),
    "adult": Run(64, 64, 0, 0, shuffle=False, cached=False),
}
SOLVERS = {
    "cifar": Solver(0.001, momentum=0.9, decay=0.004, momentum_state="local"),
    "mnist": Solver(0.01, momentum=0.9, policy="exponential", decay_rate=0.95, decay_samples=60000, form="plain"),
    "imagenet": Solver(0.01, momentum=0.9, decay=0.0005, policy="step", gamma=0.1, step_size=100000,
                       momentum_state="local"),
    "imagenet-alexnet": Solver(0.01, momentum=0.9, form="plain"),
}


def _gaussian(std: float, bias: float = 0.0) -> tuple[Filler, Filler]:
    return Filler("gaussian", std=std), Filler(value=bias)


def _truncated(bias: float = 0.0) -> tuple[Filler, Filler]:
    return Filler("truncated", std=0.1), Filler(value=bias)


def cifar_net() -> Net:
    """Three convolutions and two dense layers on 3 x 32 x 32 images."""
    twice = {"lr_mult": (1.0, 2.0)}
    wide = {"kernel": 5, "pad": 2, **twice}
    return Net("cifar", (Input("data", (3, 32, 32)), Input("label", label=True)), (
        conv("conv1", "data", 32, fillers=_gaussian(0.0001), **wide),
        pool("pool1", "conv1", "max", 3, 2), relu("relu1", "pool1"),
        conv("conv2", "pool1", 32, fillers=_gaussian(0.01), **wide), relu("relu2", "conv2"),
        pool("pool2", "conv2", "ave", 3, 2),
        conv("conv3", "pool2", 64, fillers=_gaussian(0.01), **wide), relu("relu3", "conv3"),
        pool("pool3", "conv3", "ave", 3, 2),
        dense("ip1", "pool3", 64, fillers=_gaussian(0.1), **twice),
        dense("ip2", "ip1", 10, fillers=_gaussian(0.1), **twice),
        softmax("prob", "ip2"), accuracy("accuracy", "ip2"), softmax_loss("loss", "ip2")), dtype="float32")


def mnist_net() -> Net:
    """Two convolutions and two dense layers on 28 x 28 images; the dense layers carry an L2 term."""
    return Net("mnist", (Input("data", (1, 28, 28)), Input("label", label=True)), (
        conv("conv1", "data", 32, 5, pad="SAME", fillers=_truncated()), relu("relu1", "conv1"),
        pool("pool1", "conv1", "max", 2, 2, "SAME"),
        conv("conv2", "pool1", 64, 5, pad="SAME", fillers=_truncated(0.1)), relu("relu2", "conv2"),
        pool("pool2", "conv2", "max", 2, 2, "SAME"),
        dense("fc1", "pool2", 512, fillers=_truncated(0.1)), relu("relu3", "fc1"),
        dense("fc2", "fc1", 10, fillers=_truncated(0.1)),
        softmax("prob", "fc2"), accuracy("accuracy", "fc2"), softmax_loss("loss", "fc2")),
        l2={"fc1": 5e-4, "fc2": 5e-4}, dtype="float32")


def alexnet(classes: int = 1000, with_dropout: bool = False) -> Net:
    """Five convolutions and three dense layers on 3 x 227 x 227 images, without response normalisation."""
    layers = [conv("conv1", "data", 64, 11, stride=4, pad="SAME", fillers=_truncated()), relu("relu1", "conv1"),
              pool("pool1", "conv1", "max", 3, 2, "VALID")]
    source = "pool1"
    for at, (outputs, kernel) in enumerate([(192, 5), (384, 3), (256, 3), (256, 3)], start=2):
        layers += [conv(f"conv{at}", source, outputs, kernel, pad="SAME", fillers=_truncated()), relu(f"relu{at}", f"conv{at}")]
        source = f"conv{at}"
        if at in (2, 5):
            layers.append(pool(f"pool{at}", source, "max", 3, 2, "VALID"))
            source = f"pool{at}"
    for name, outputs in [("fc6", 4096), ("fc7", 4096)]:
        layers += [dense(name, source, outputs, fillers=_truncated()), relu(f"relu_{name}", name)]
        layers += [dropout(f"drop_{name}", name)] if with_dropout else []
        source = name
    layers += [dense("fc8", source, classes, fillers=_truncated()), softmax("probs", "fc8"),
               accuracy("accuracy", "fc8"), softmax_loss("loss", "fc8")]
    return Net("alexnet", (Input("data", (3, 227, 227)), Input("label", label=True)), tuple(layers), dtype="float32")


def adult_net() -> Net:
    """One dense layer of ten outputs with softmax on a single column."""
    return Net("adult", (Input("C0"),), (
        dense("ip", "C0", 10, fillers=(Filler("xavier"), Filler()), lr_mult=(1.0, 2.0)), softmax("prob", "ip")))


NETS = {"cifar": cifar_net, "mnist": mnist_net, "imagenet": lambda: alexnet(with_dropout=True), "imagenet-alexnet": alexnet,
        "featurize": cifar_net, "adult": adult_net}
