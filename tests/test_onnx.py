import numpy as np
import pytest

from microbook.plans.training import score_with_onnx
from microbook.schema import FEATURE_NAMES
from tests.helpers import frame

pytest.importorskip("onnxruntime")


def number(field, value):
    out, value = bytearray([field << 3]), int(value)
    while True:
        out.append(value & 0x7F | (0x80 if value > 0x7F else 0))
        value >>= 7
        if not value:
            return bytes(out)


def block(field, payload):
    payload = payload.encode() if isinstance(payload, str) else payload
    return bytes([field << 3 | 2]) + number(0, len(payload))[1:] + payload


def tensor_type(name, *dims):
    shape = b"".join(block(1, number(1, d) if isinstance(d, int) else block(2, d)) for d in dims)
    return block(1, name) + block(2, block(1, number(1, 1) + block(2, shape)))


def softmax_model(weights):
    """A file with probabilities = softmax(x . weights)."""
    rows, cols = weights.shape
    init = number(1, rows) + number(1, cols) + number(2, 1) + block(8, "w") + block(9, weights.astype("<f4").tobytes())
    product = block(1, "x") + block(1, "w") + block(2, "z") + block(4, "MatMul")
    softmax = block(1, "z") + block(2, "p") + block(4, "Softmax")
    graph = block(1, product) + block(1, softmax) + block(2, "g") + block(5, init)
    graph += block(11, tensor_type("x", "n", rows)) + block(12, tensor_type("p", "n", cols))
    return number(1, 8) + block(7, graph) + block(8, block(1, "") + number(2, 13))


def test_onnx_scores(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(len(FEATURE_NAMES), 3)).astype("float32")
    x = rng.normal(size=(40, len(FEATURE_NAMES))).astype("float32")
    matrix = frame(spark, [dict(zip(FEATURE_NAMES, map(float, r))) for r in x])
    for parts in (1, 5):  # alone or in batches of any size: same scores
        out = score_with_onnx(matrix.repartition(parts), softmax_model(weights)).orderBy("seq").toPandas()
        z = np.exp(x.astype(float) @ weights)
        assert np.allclose(out[["p_down", "p_stable", "p_up"]].to_numpy(), z / z.sum(axis=1, keepdims=True), rtol=1e-4)
