import numpy as np
import pytest

from lexigrid.operators import cnn
from lexigrid.plans import images


def test_parameters():
    for hidden in (10, 50):
        assert cnn.formula_weights(hidden).parameters() == 5400 + 381 * hidden


def slow_conv(x, w, b):
    n, _, h, v = x.shape
    out = np.zeros((n, len(w), h - 4, v - 4))
    for y in range(h - 4):
        for z in range(v - 4):
            out[:, :, y, z] = np.einsum("ncij,ocij->no", x[:, :, y : y + 5, z : z + 5], w) + b
    return out


def test_layers_against_slow_ones():
    w, x = cnn.formula_weights(), np.random.default_rng(3).normal(size=(3, 784))
    one = slow_conv(x.reshape(3, 1, 28, 28), w.conv1_w, w.conv1_b)
    assert np.allclose(cnn.forward(x, w, "conv1"), one.reshape(3, -1))
    normed = (one - w.bn1.mean[:, None, None]) / np.sqrt(w.bn1.var + 1e-5)[:, None, None] * w.bn1.gamma[:, None, None] + w.bn1.beta[:, None, None]
    pooled = np.array([[[[normed[n, c, 2 * y : 2 * y + 2, 2 * z : 2 * z + 2].max() for z in range(12)] for y in range(12)] for c in range(10)] for n in range(3)])
    assert np.allclose(cnn.forward(x, w, "pool1"), pooled.reshape(3, -1))
    two = slow_conv(np.maximum(pooled, 0), w.conv2_w, w.conv2_b)
    assert np.allclose(cnn.forward(x, w, "conv2"), two.reshape(3, -1))
    logp = cnn.forward(x, w)
    assert logp.shape == (3, 60) and np.allclose(np.exp(logp).sum(1), 1)


def test_wrong_size_raises(spark):
    with pytest.raises(ValueError, match="784"):
        cnn.forward(np.zeros((2, 783)), cnn.formula_weights())
    small = spark.createDataFrame([([0.0] * 784,), ([0.0] * 10,)], "pixels array<double>")
    with pytest.raises(Exception, match="784"):
        cnn.layer(small, cnn.formula_weights()).collect()


@pytest.mark.parametrize("name", ["cnn_pool1", "cnn_linear1"])
def test_relational_form(same_as_sql, name):
    same_as_sql(images.QUERIES[name], images.ORACLE_SQL[name])
