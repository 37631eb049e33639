"""Forward pass of a small convolutional classifier: 1x28x28 images, 60 classes, inference only (dropout does nothing then).

Layers: convolution 1 to 10 (5x5), batch norm, 2x2 max pooling, ReLU; convolution 10 to 20 (5x5), batch norm, pooling, ReLU; flatten to
320; linear, ReLU; linear to the classes; log-softmax. Note that pooling comes between batch norm and ReLU.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, KERNEL, CLASSES = 28, 5, 60
EPSILON = 1e-5
LAYERS = ("conv1", "bn1", "pool1", "relu1", "conv2", "bn2", "pool2", "relu2", "fc1", "fc2", "log_softmax")


@dataclass
class Norm:
    mean: np.ndarray
    var: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray


@dataclass
class Weights:
    conv1_w: np.ndarray  # 10, 1, 5, 5
    conv1_b: np.ndarray
    bn1: Norm
    conv2_w: np.ndarray  # 20, 10, 5, 5
    conv2_b: np.ndarray
    bn2: Norm
    fc1_w: np.ndarray  # hidden, 320
    fc1_b: np.ndarray
    fc2_w: np.ndarray  # 60, hidden
    fc2_b: np.ndarray

    def parameters(self) -> int:
        parts = [self.conv1_w, self.conv1_b, self.conv2_w, self.conv2_b, self.fc1_w, self.fc1_b, self.fc2_w, self.fc2_b]
        return sum(p.size for p in parts) + sum(n.gamma.size + n.beta.size for n in (self.bn1, self.bn2))


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cross-correlation, stride 1, no padding: patches as rows of one matrix product."""
    windows = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], (2, 3))
    n, _, h, v = windows.shape[:4]
    patches = windows.transpose(0, 2, 3, 1, 4, 5).reshape(n * h * v, -1)
    return (patches @ w.reshape(len(w), -1).T + b).reshape(n, h, v, len(w)).transpose(0, 3, 1, 2)


def batch_norm(x: np.ndarray, norm: Norm) -> np.ndarray:
    scale = norm.gamma / np.sqrt(norm.var + EPSILON)
    return x * scale[:, None, None] + (norm.beta - norm.mean * scale)[:, None, None]


def max_pool(x: np.ndarray) -> np.ndarray:
    n, c, h, v = x.shape
    return x[:, :, : h // 2 * 2, : v // 2 * 2].reshape(n, c, h // 2, 2, v // 2, 2).max((3, 5))


def log_softmax(x: np.ndarray) -> np.ndarray:
    low = x - x.max(1, keepdims=True)
    return low - np.log(np.exp(low).sum(1, keepdims=True))


def forward(pixels: np.ndarray, w: Weights, upto: str = LAYERS[-1]) -> np.ndarray:
    """The output of a layer, one row an image, channel-major. pixels: (n, 784); another size raises."""
    if pixels.ndim != 2 or pixels.shape[1] != SIDE * SIDE:
        raise ValueError(f"an image must have {SIDE * SIDE} pixels")
    steps = (
        lambda x: conv(x, w.conv1_w, w.conv1_b),
        lambda x: batch_norm(x, w.bn1),
        max_pool,
        lambda x: np.maximum(x, 0),
        lambda x: conv(x, w.conv2_w, w.conv2_b),
        lambda x: batch_norm(x, w.bn2),
        max_pool,
        lambda x: np.maximum(x, 0).reshape(len(x), -1),
        lambda x: np.maximum(x @ w.fc1_w.T + w.fc1_b, 0),
        lambda x: x @ w.fc2_w.T + w.fc2_b,
        log_softmax,
    )
    x = pixels.reshape(-1, 1, SIDE, SIDE)
    for step in steps[: LAYERS.index(upto) + 1]:
        x = step(x)
    return x.reshape(len(x), -1)


def layer(images: DataFrame, weights: Weights, upto: str = LAYERS[-1], pixels_col: str = "pixels", name: str = "out", at_once: int = 64) -> DataFrame:
    """images with a layer's output as an array of doubles. Null pixels raise, as do images of another size."""

    def run(pixels: pa.Array) -> pa.Array:
        if pixels.null_count or (len(pixels) and {*pixels.value_lengths().to_pylist()} != {SIDE * SIDE}):
            raise ValueError(f"an image must have {SIDE * SIDE} pixels")
        x = pixels.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, SIDE * SIDE)
        parts = [forward(x[at : at + at_once], weights, upto) for at in range(0, len(x), at_once)]
        out = np.concatenate(parts) if parts else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype="i4") * out.shape[1]), pa.array(out.ravel()))

    return images.withColumn(name, F.arrow_udf(run, "array<double>")(pixels_col))


def predict(images: DataFrame, weights: Weights, pixels_col: str = "pixels") -> DataFrame:
    """images with logp (array of 60) and digit, the likeliest class (the first of equals)."""
    done = layer(images, weights, pixels_col=pixels_col, name="logp")
    return done.withColumn("digit", F.array_position("logp", F.array_max("logp")) - 1)


def steps(n: int, factor: int, add: int, period: int, minus: int, over: float) -> np.ndarray:
    """((k * factor + add) mod period - minus) / over, for k from 0."""
    return ((np.arange(n) * factor + add) % period - minus) / over


def formula_weights(hidden: int = 50) -> Weights:
    """Weights from a rule, as trained ones are not at hand."""

    def norm(n: int) -> Norm:
        return Norm(steps(n, 1, 0, 5, 2, 10.0), 1.0 + steps(n, 1, 0, 3, 0, 2.0), 1.0 + steps(n, 1, 0, 3, 0, 10.0), steps(n, 1, 0, 4, 1, 10.0))

    return Weights(
        steps(250, 7, 3, 11, 5, 25.0).reshape(10, 1, 5, 5),
        steps(10, 1, 0, 3, 1, 10.0),
        norm(10),
        steps(5000, 13, 5, 19, 9, 200.0).reshape(20, 10, 5, 5),
        steps(20, 1, 0, 5, 2, 10.0),
        norm(20),
        steps(320 * hidden, 11, 7, 23, 11, 100.0).reshape(hidden, 320),
        steps(hidden, 1, 0, 7, 3, 10.0),
        steps(60 * hidden, 5, 1, 13, 6, 20.0).reshape(60, hidden),
        steps(60, 1, 0, 4, 1, 10.0),
    )
