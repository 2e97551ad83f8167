"""The public level 5 MAT format: numbers, text, cells and structs, compressed or not; and a writer of the same."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# The number types of elements, and the classes of arrays.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED, UTF8, UTF16 = 14, 15, 16, 17
CELL, STRUCT, CHAR = 1, 2, 4


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, body) of elements one after another; short ones have both in eight bytes."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _numbers(kind: int, body: bytes, order: str) -> np.ndarray:
    if kind not in ELEMENTS:
        raise ValueError(f"a number type {kind} is not read")
    return np.frombuffer(body, order + ELEMENTS[kind])


def _matrix(body: bytes, order: str) -> tuple[str, object]:
    """(name, value): arrays, str, lists of the values of cells, dicts of structs (lists of dicts where there are several)."""
    parts = list(_elements(body, order))
    if not parts:
        return "", np.zeros((0, 0))
    flags = _numbers(6, parts[0][1], order)[0]
    shape = tuple(int(x) for x in _numbers(5, parts[1][1], order))
    name, cls, rest = parts[2][1].decode("latin1"), int(flags) & 255, parts[3:]
    if flags & 0x800:
        raise ValueError("complex numbers are not read")
    if cls == CELL:
        return name, [_matrix(b, order)[1] for _, b in rest]
    if cls == STRUCT:
        width = int(_numbers(5, rest[0][1], order)[0])
        fields = [rest[1][1][i : i + width].split(b"\0")[0].decode("latin1") for i in range(0, len(rest[1][1]), width)]
        values = [_matrix(b, order)[1] for _, b in rest[2:]]
        rows = [dict(zip(fields, values[i : i + len(fields)], strict=True)) for i in range(0, len(values), max(len(fields), 1))]
        return name, rows[0] if len(rows) == 1 else rows
    if cls == CHAR:
        kind, raw = rest[0] if rest else (UTF8, b"")
        text = raw.decode("utf-8" if kind == UTF8 else ("utf-16-le" if order == "<" else "utf-16-be")) if kind in (UTF8, UTF16, 4) else raw.decode("latin1")
        lines = ["".join(text[r :: shape[0]]) for r in range(shape[0])] if shape[0] > 1 else [text]
        return name, lines[0] if len(lines) == 1 else lines
    if cls not in CLASSES:
        raise ValueError(f"an array of class {cls} is not read")
    return name, _numbers(*rest[0], order).astype(CLASSES[cls]).reshape(shape, order="F")


def load(data: bytes) -> dict[str, object]:
    """The variables of a file by name."""
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MAT file")
    order, out = "<" if mark == b"IM" else ">", {}
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def _element(kind: int, body: bytes) -> bytes:
    if 0 < len(body) <= 4:
        return struct.pack("<HH", kind, len(body)) + body + bytes(4 - len(body))
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def _array(name: str, value) -> bytes:
    if isinstance(value, str):
        cls, shape, body = CHAR, (1, len(value)), [_element(UTF16, value.encode("utf-16-le"))]
    elif isinstance(value, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        cls, shape, body = STRUCT, (1, 1), [_element(5, struct.pack("<i", 32)), _element(1, names), *[_array("", v) for v in value.values()]]
    elif isinstance(value, list):
        cls, shape, body = CELL, (1, len(value)), [_array("", v) for v in value]
    else:
        a = np.atleast_2d(np.asarray(value, "<f8"))
        cls, shape, body = 6, a.shape, [_element(9, a.tobytes(order="F"))]
    parts = [_element(6, struct.pack("<II", cls, 0)), _element(5, struct.pack(f"<{len(shape)}i", *shape)), _element(1, name.encode()), *body]
    return _element(MATRIX, b"".join(parts))


def dump(variables: dict[str, object], compressed: bool = True) -> list[bytes]:
    """A file's parts: numbers as doubles, str, lists as cells, dicts as structs."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in variables.items():
        body = _array(name, value)
        packed = zlib.compress(body)
        out.append(struct.pack("<II", COMPRESSED, len(packed)) + packed if compressed else body)
    return out
