"""Hand-encoded ONNX model for tests (the onnx package is not installed): logits = flatten(x) W + b.

Protobuf wire format written directly: ModelProto -> GraphProto -> NodeProto / TensorProto /
ValueInfoProto, fields by their numbers in the public onnx.proto schema.
"""

import struct

import numpy as np


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def _int(field: int, v: int) -> bytes:
    return _key(field, 0) + _varint(v)


def _bytes(field: int, v: bytes) -> bytes:
    return _key(field, 2) + _varint(len(v)) + v


def _str(field: int, v: str) -> bytes:
    return _bytes(field, v.encode())


def _tensor(name: str, arr: np.ndarray) -> bytes:
    dims = b"".join(_int(1, d) for d in arr.shape)
    return dims + _int(2, 1) + _str(8, name) + _bytes(9, arr.astype("<f4").tobytes())


def _value_info(name: str, dims) -> bytes:
    dim_msgs = b"".join(_bytes(1, _str(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    tensor_type = _int(1, 1) + _bytes(2, dim_msgs)  # elem_type FLOAT, shape
    return _str(1, name) + _bytes(2, _bytes(1, tensor_type))


def _node(op: str, inputs, outputs, attrs=b"") -> bytes:
    return b"".join(_str(1, i) for i in inputs) + b"".join(_str(2, o) for o in outputs) + _str(4, op) + attrs


def linear_model(w: np.ndarray, b: np.ndarray, size: int) -> bytes:
    """Input ``input`` [N, 3, size, size] -> output ``output`` [N, K] = flatten(input) @ w + b."""
    k = w.shape[1]
    flatten_axis = _bytes(5, _str(1, "axis") + _int(3, 1) + _int(20, 2))  # AttributeProto INT
    graph = (
        _bytes(1, _node("Flatten", ["input"], ["flat"], flatten_axis))
        + _bytes(1, _node("MatMul", ["flat", "W"], ["mm"]))
        + _bytes(1, _node("Add", ["mm", "B"], ["output"]))
        + _str(2, "linear")
        + _bytes(5, _tensor("W", w))
        + _bytes(5, _tensor("B", b))
        + _bytes(11, _value_info("input", ["N", 3, size, size]))
        + _bytes(12, _value_info("output", ["N", k]))
    )
    opset = _str(1, "") + _int(2, 13)
    return _int(1, 8) + _str(2, "tests") + _bytes(7, graph) + _bytes(8, opset)


__all__ = ["linear_model", "struct"]
