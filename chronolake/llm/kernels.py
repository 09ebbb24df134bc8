"""Inner loops that numpy is slow at on one thread, run by onnxruntime's kernels: the same float32 results but for rounding.

Each is one ONNX operator on buffers of numpy; nothing is loaded from files. Where onnxruntime is not installed, numpy does the same.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

#: Fixed values of the ONNX format: numbers of types, wire kinds, versions of its file format and of its operators.
_KINDS, _IR, _OPERATORS = {"f": 1, "i": 7}, 8, 18


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _model(op: str, inputs: str, numbers: dict[str, int], names: dict[str, str]) -> bytes:
    """An ONNX file of one operator, whose inputs a, b, .. are floats (f) or 64-bit integers (i) and whose output is y."""
    letters = "abc"[: len(inputs)]
    attributes = [_field(1, k) + _field(3, v) + _field(20, 2) for k, v in numbers.items()] + [_field(1, k) + _field(4, v) + _field(20, 3) for k, v in names.items()]
    node = b"".join(_field(1, x) for x in letters) + _field(2, "y") + _field(4, op) + b"".join(_field(5, a) for a in attributes)
    typed = lambda name, kind: _field(1, name) + _field(2, _field(1, _field(1, _KINDS[kind])))
    graph = _field(1, node) + _field(2, "g") + b"".join(_field(11, typed(x, k)) for x, k in zip(letters, inputs, strict=True)) + _field(12, typed("y", "f"))
    return _field(1, _IR) + _field(7, graph) + _field(8, _field(1, "") + _field(2, _OPERATORS))


@functools.lru_cache(maxsize=8)
def _session(op: str, inputs: str, numbers: tuple = (), names: tuple = ()):
    """One per process and operator, on the caller's thread."""
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.enable_cpu_mem_arena, options.log_severity_level = False, 3
    return onnxruntime.InferenceSession(_model(op, inputs, dict(numbers), dict(names)), options, providers=["CPUExecutionProvider"])


def _bound(session, inputs: list[np.ndarray], out: np.ndarray) -> Callable[[], None]:
    """A call that fills out; it keeps the arrays, whose addresses are fixed here."""
    if not all(x.flags.c_contiguous for x in [*inputs, out]):
        raise ValueError("arrays must be contiguous")
    binding = session.io_binding()
    for name, x in zip("abc", inputs):  # noqa: B905
        binding.bind_input(name, "cpu", 0, x.dtype.type, x.shape, x.ctypes.data)
    binding.bind_output("y", "cpu", 0, np.float32, out.shape, out.ctypes.data)
    kept = [*inputs, out]
    return lambda: (kept, session.run_with_iobinding(binding))[:0]


class Exp:
    """exp of the first rows of a float32 buffer, in place."""

    def __init__(self, buffer: np.ndarray):
        self.buffer = buffer
        self.whole = _bound(_session("Exp", "f"), [buffer], buffer) if onnxruntime else None

    def __call__(self, rows: int) -> None:
        if self.whole and rows == len(self.buffer):
            self.whole()
        else:
            np.exp(self.buffer[:rows], out=self.buffer[:rows])


class AddProduct:
    """Adds the product of a and b to y; a and y have as many rows."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray):
        self.a, self.b, self.y = a, b, y
        self.whole = _bound(_session("Gemm", "fff"), [a, b, y], y) if onnxruntime else None

    def __call__(self, rows: int) -> None:
        """To the first rows."""
        if self.whole and rows == len(self.a):
            self.whole()
        else:
            self.y[:rows] += self.a[:rows] @ self.b


class Product:
    """The transpose of a buffer times another, both of as many rows."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.out = a, b, np.empty((a.shape[1], b.shape[1]), np.float32)
        self.whole = _bound(_session("Gemm", "ff", (("transA", 1),)), [a, b], self.out) if onnxruntime else None

    def __call__(self, rows: int) -> np.ndarray:
        """Of the first rows; the next call overwrites the result."""
        if self.whole and rows == len(self.a):
            self.whole()
        else:
            np.matmul(self.a[:rows].T, self.b[:rows], out=self.out)
        return self.out


def by_row(at: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """(rows, width): the sums of x (..., width) by the rows at."""
    width = x.shape[-1]
    if onnxruntime:
        out = np.empty((rows, width), np.float32)
        at, x = np.ascontiguousarray(at.reshape(-1, 1), np.int64), np.ascontiguousarray(x.reshape(-1, width), np.float32)
        _bound(_session("ScatterND", "fif", (), (("reduction", "add"),)), [np.zeros_like(out), at, x], out)()
        return out
    at, columns = at.reshape(-1).astype(np.intp), np.ascontiguousarray(x.reshape(-1, width).T, np.float64)
    return np.stack([np.bincount(at, c, rows) for c in columns], axis=1).astype(np.float32)  # a column's sums stay in the cache
