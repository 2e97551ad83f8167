"""The part of the public HDF5 format that recordings use: groups, small datasets, and chunked matrices.

Reading: superblocks 0 to 3, object headers 1 and 2, symbol-table groups and compact links, fixed-point, floating
and string types (fixed and variable length), compact, contiguous and chunked layouts (tree index, single chunk),
deflate, shuffle and checksum filters. Byte ranges are fetched as they are needed, so that a task reads its
chunks only. Groups with dense links, other chunk indices and other types raise Unsupported.
Writing: superblock 0 with symbol-table groups, which every version of the format's library reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

SIGNATURE, NONE = b"\x89HDF\r\n\x1a\n", 0xFFFFFFFFFFFFFFFF
#: Half the entries of a symbol node, of a group's tree node and of a chunk tree's node, as written.
LEAF_K, GROUP_K, CHUNK_K = 4, 16, 32


class Unsupported(ValueError):
    """The file uses a part of the format that is not read here."""


def padded(data: bytes, to: int = 8) -> bytes:
    return data + bytes(-len(data) % to)


@dataclass
class Dataset:
    shape: tuple[int, ...]
    kind: tuple  # ("number", dtype), ("fixed", size) or ("variable",)
    layout: tuple  # ("compact", bytes), ("contiguous", address, size) or ("chunked", chunk shape, index, address)
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)

    @property
    def itemsize(self) -> int:
        return self.kind[1].itemsize if self.kind[0] == "number" else self.kind[1] if self.kind[0] == "fixed" else 16


class File:
    """read(offset, n) gives n bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, at = read, 0
        while read(at, 8) != SIGNATURE:
            at = max(512, at * 2)
            if at >= size:
                raise Unsupported("no HDF5 signature")
        version = read(at + 8, 1)[0]
        if version < 2:
            if read(at + 13, 2) != b"\x08\x08":
                raise Unsupported("offsets of other than 8 bytes")
            skip = at + 24 + 4 * (version == 1)
            self.base = struct.unpack("<Q", read(skip, 8))[0]
            self.root = struct.unpack("<Q", read(skip + 40, 8))[0]
        else:
            self.base, _, _, self.root = struct.unpack("<4Q", read(at + 12, 32))
        self._messages: dict[int, list[tuple[int, bytes]]] = {}
        self._links: dict[int, dict[str, int]] = {}

    def at(self, address: int, n: int) -> bytes:
        return self.read(self.base + address, n)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, body) of the messages of an object header."""
        if address not in self._messages:
            start = self.at(address, 16)
            self._messages[address] = list(self._new(address) if start[:4] == b"OHDR" else self._old(address, start))
        return self._messages[address]

    def _old(self, address: int, start: bytes) -> Iterator[tuple[int, bytes]]:
        blocks = [(address + 16, struct.unpack_from("<I", start, 8)[0])]
        for where, size in blocks:
            data, p = self.at(where, size), 0
            while p + 8 <= size:
                kind, n = struct.unpack_from("<HH", data, p)
                body, p = data[p + 8 : p + 8 + n], p + 8 + n
                if kind == 0x10:
                    blocks.append(struct.unpack_from("<QQ", body))
                elif kind:
                    yield kind, body

    def _new(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self.at(address, 48)
        flags, width = head[5], 1 << (head[5] & 3)
        p = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
        blocks = [(address + p + width, int.from_bytes(head[p : p + width], "little"))]
        per = 4 + 2 * bool(flags & 4)
        for where, size in blocks:
            data, p = self.at(where, size), 0
            while p + per <= size:
                kind, n = data[p], struct.unpack_from("<H", data, p + 1)[0]
                body, p = data[p + per : p + per + n], p + per + n
                if kind == 0x10:
                    to, length = struct.unpack_from("<QQ", body)
                    blocks.append((to + 4, length - 8))  # between the block's signature and its checksum
                elif kind:
                    yield kind, body

    def links(self, address: int) -> dict[str, int]:
        """Members of a group by name."""
        if address not in self._links:
            out: dict[str, int] = {}
            for kind, body in self.messages(address):
                if kind == 0x11:
                    tree, heap = struct.unpack_from("<QQ", body)
                    names = struct.unpack("<Q", self.at(heap + 24, 8))[0]
                    text = self.at(names, struct.unpack("<Q", self.at(heap + 8, 8))[0])
                    for _, node in self._tree(tree, 8):
                        n = struct.unpack("<H", self.at(node + 6, 2))[0]
                        entries = self.at(node + 8, 40 * n)
                        for i in range(n):
                            name, to = struct.unpack_from("<QQ", entries, 40 * i)
                            out[text[name : text.index(b"\0", name)].decode()] = to
                elif kind == 0x06:
                    name, to = self._link(body)
                    if to is not None:
                        out[name] = to
                elif kind == 0x02:
                    heap = struct.unpack_from("<Q", body, 2 + 8 * bool(body[1] & 1))[0]
                    if heap != NONE:
                        raise Unsupported("a group with dense links")
            self._links[address] = out
        return self._links[address]

    @staticmethod
    def _link(body: bytes) -> tuple[str, int | None]:
        flags, p = body[1], 2
        hard = not flags & 8 or body[p] == 0
        p += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        n, p = int.from_bytes(body[p : p + width], "little"), p + width
        return body[p : p + n].decode(), struct.unpack_from("<Q", body, p + n)[0] if hard else None

    def _tree(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, address) of the leaves of a version 1 tree."""
        if address == NONE:
            return
        head = self.at(address, 24)
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        data = self.at(address + 24, n * (key + 8))
        for i in range(n):
            to = struct.unpack_from("<Q", data, i * (key + 8) + key)[0]
            if level:
                yield from self._tree(to, key)
            else:
                yield data[i * (key + 8) : i * (key + 8) + key], to

    def find(self, path: str) -> int | None:
        here: int | None = self.root
        for name in path.strip("/").split("/"):
            here = self.links(here).get(name) if here is not None else None
        return here

    def dataset(self, address: int) -> Dataset:
        parts = dict(self.messages(address))
        if not {1, 3, 8} <= set(parts):
            raise Unsupported("not a dataset")
        shape = self._shape(parts[1])
        kind = self._kind(parts[3])
        return Dataset(shape, kind, self._layout(parts[8], len(shape)), self._filters(parts[11]) if 11 in parts else [])

    @staticmethod
    def _shape(body: bytes) -> tuple[int, ...]:
        rank, null = body[1], body[0] == 2 and body[3] == 2
        return (0,) if null else struct.unpack_from(f"<{rank}Q", body, 8 if body[0] == 1 else 4)

    @staticmethod
    def _kind(body: bytes) -> tuple:
        cls, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
        order = ">" if bits & 1 else "<"
        if cls in (0, 1):
            return "number", np.dtype(f"{order}{'f' if cls else 'i' if bits & 8 else 'u'}{size}")
        if cls == 3:
            return "fixed", size
        if cls == 9 and bits & 15 == 1:
            return ("variable",)
        raise Unsupported(f"a type of class {cls}")

    @staticmethod
    def _layout(body: bytes, rank: int) -> tuple:
        version, cls = body[0], body[1]
        if version < 3:
            n, cls = body[1], body[2]
            address = struct.unpack_from("<Q", body, 8)[0] if cls else NONE
            dims = struct.unpack_from(f"<{n}I", body, 8 + 8 * bool(cls))
            if cls == 0:
                return "compact", body[12 + 4 * n :]
            return ("contiguous", address, None) if cls == 1 else ("chunked", dims[:-1], "tree", address)
        if cls == 0:
            return "compact", body[4 : 4 + struct.unpack_from("<H", body, 2)[0]]
        if cls == 1:
            return "contiguous", *struct.unpack_from("<QQ", body, 2)
        if version == 3:
            n = body[2]
            return "chunked", struct.unpack_from(f"<{n - 1}I", body, 11), "tree", struct.unpack_from("<Q", body, 3)[0]
        flags, n, width = body[2], body[3], body[4]
        dims = [int.from_bytes(body[5 + i * width : 5 + (i + 1) * width], "little") for i in range(n - 1)]
        p = 5 + n * width
        if body[p] != 1:
            raise Unsupported("a chunk index other than a tree or a single chunk")
        size = struct.unpack_from("<Q", body, p + 1)[0] if flags & 2 else None
        return "chunked", tuple(dims), ("single", size), struct.unpack_from("<Q", body, p + 1 + 12 * bool(flags & 2))[0]

    @staticmethod
    def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        out, p = [], 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            number = struct.unpack_from("<H", body, p)[0]
            named = body[0] == 1 or number >= 256
            length = struct.unpack_from("<H", body, p + 2)[0] if named else 0
            p += 2 + 2 * named
            _, n = struct.unpack_from("<HH", body, p)
            p += 4 + (-(-length // 8) * 8 if body[0] == 1 else length)
            out.append((number, struct.unpack_from(f"<{n}I", body, p)))
            p += 4 * n + (4 * (n % 2) if body[0] == 1 else 0)
        return out

    def chunks(self, d: Dataset) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """(address, stored size, mask of skipped filters, offsets) of a chunked dataset's chunks, in their order."""
        _, dims, index, address = d.layout
        rank, whole = len(d.shape), int(np.prod(dims)) * d.itemsize
        if index != "tree":
            return [] if address == NONE else [(address, index[1] or whole, 0, (0,) * rank)]
        return [(to, *struct.unpack_from("<II", key), struct.unpack_from(f"<{rank}Q", key, 8)) for key, to in self._tree(address, 8 + 8 * (rank + 1))]

    def chunk(self, d: Dataset, where: tuple[int, int, int, tuple[int, ...]]) -> np.ndarray:
        """The values of one chunk that lie inside the dataset."""
        address, size, mask, offset = where
        data = self.at(address, size)
        for i, (number, values) in reversed(list(enumerate(d.filters))):
            if mask >> i & 1:
                continue
            if number == 1:
                data = zlib.decompress(data)
            elif number == 2:
                n = values[0] if values else d.itemsize
                body = len(data) // n * n
                data = np.frombuffer(data[:body], np.uint8).reshape(n, -1).T.tobytes() + data[body:]
            elif number == 3:
                data = data[:-4]
            else:
                raise Unsupported(f"filter {number}")
        cells = self._decoded(d, data).reshape(d.layout[1])
        return cells[tuple(slice(0, max(0, min(c, s - o))) for c, s, o in zip(d.layout[1], d.shape, offset, strict=True))]

    def _decoded(self, d: Dataset, data: bytes) -> np.ndarray:
        if d.kind[0] == "number":
            return np.frombuffer(data, d.kind[1])
        if d.kind[0] == "fixed":
            raw = [data[i : i + d.kind[1]] for i in range(0, len(data), d.kind[1])]
            return np.array([x.split(b"\0")[0].decode("utf-8", "replace").rstrip(" ") for x in raw], object)
        return np.array([self._heap_string(data[i : i + 16]) for i in range(0, len(data), 16)], object)

    def _heap_string(self, ref: bytes) -> str:
        length, address, number = struct.unpack("<IQI", ref)
        if not length:
            return ""
        size, p = struct.unpack("<Q", self.at(address + 8, 8))[0], 16
        data = self.at(address, size)
        while p + 16 <= size:
            index, _, _, n = struct.unpack_from("<HHIQ", data, p)
            if index == number:
                return data[p + 16 : p + 16 + length].split(b"\0")[0].decode("utf-8", "replace")
            if index == 0:
                break
            p += 16 + -(-n // 8) * 8
        raise Unsupported("a string that its heap lacks")

    def values(self, d: Dataset, first: int = 0, upto: int | None = None) -> np.ndarray:
        """Rows first to before upto (of the first dimension), all by default; only what holds them is read."""
        upto = (d.shape[0] if d.shape else 1) if upto is None else upto
        per = int(np.prod(d.shape[1:])) * d.itemsize
        shape = (upto - first, *d.shape[1:]) if d.shape else ()
        if d.layout[0] != "chunked":
            data = d.layout[1][first * per : upto * per] if d.layout[0] == "compact" else b"" if d.layout[1] == NONE else self.at(d.layout[1] + first * per, (upto - first) * per)
            return self._decoded(d, data).reshape(shape) if data or d.kind[0] != "number" else np.zeros(shape, d.kind[1])
        out = np.zeros(shape, d.kind[1] if d.kind[0] == "number" else object)
        for where in self.chunks(d):
            o = where[3]
            if o[0] < upto and o[0] + d.layout[1][0] > first:
                part = self.chunk(d, where)
                a, b = max(o[0], first), min(o[0] + part.shape[0], upto)
                out[(slice(a - first, b - first), *[slice(x, x + n) for x, n in zip(o[1:], part.shape[1:], strict=True)])] = part[a - o[0] : b - o[0]]
        return out

    def get(self, group: int, name: str, default=None):
        """A small dataset of a group: a scalar, a string, or an array."""
        to = self.links(group).get(name)
        if to is None:
            return default
        got = self.values(self.dataset(to))
        return got.reshape(-1)[0] if got.size == 1 and got.ndim < 2 else got


class Writer:
    """Builds a file in memory; chunks are compressed as they come."""

    def __init__(self):
        self.parts, self.size = [bytes(96)], 96

    def put(self, data: bytes) -> int:
        at, data = self.size, padded(data)
        self.parts.append(data)
        self.size += len(data)
        return at

    def _header(self, *messages: tuple[int, bytes]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(padded(m)), 0) + padded(m) for kind, m in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    @staticmethod
    def _kind(dtype: np.dtype) -> bytes:
        if dtype.kind == "S":
            return struct.pack("<B3BI", 0x13, 0x11, 0, 0, dtype.itemsize)
        if dtype.kind == "f":
            return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
        return struct.pack("<B3BIHH", 0x10, 8, 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)

    @staticmethod
    def _space(shape: tuple[int, ...]) -> bytes:
        return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)

    _FILL = (0x05, struct.pack("<BBBB", 2, 2, 2, 0))

    def dataset(self, value) -> int:
        """A scalar or array of numbers or strings."""
        a = np.asarray(value)
        if a.dtype.kind in "UO":
            a = np.array([str(x).encode() or b"\0" for x in a.reshape(-1)], "S").reshape(a.shape)
        a = a.astype("<f8" if a.dtype.kind == "f" else f"<i{max(a.dtype.itemsize, 4)}" if a.dtype.kind in "iub" else a.dtype)
        where = self.put(a.tobytes()) if a.size else NONE
        return self._header((1, self._space(a.shape)), (3, self._kind(a.dtype)), self._FILL, (8, struct.pack("<BBQQ", 3, 1, where, a.nbytes)))

    def chunked(self, parts: Iterator[np.ndarray], rows: int, columns: int, level: int = 4) -> int:
        """A matrix of doubles from blocks of rows rows (the last may have fewer), deflated and shuffled."""
        keys, total = [], 0
        for part in parts:
            full = np.zeros((rows, columns))
            full[: len(part)] = part
            data = zlib.compress(np.frombuffer(full.astype("<f8").tobytes(), np.uint8).reshape(-1, 8).T.tobytes(), level)
            keys.append((struct.pack("<II3Q", len(data), 0, total, 0, 0), self.put(data)))
            total += len(part)
        end = struct.pack("<II3Q", 0, 0, total, columns, 0)
        tree = self._tree(1, keys, end, CHUNK_K) if keys else NONE
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", 2, 0, 1, 1, 8, 0) + struct.pack("<HHHHII", 1, 0, 1, 1, level, 0)
        return self._header((1, self._space((total, columns))), (3, self._kind(np.dtype("<f8"))), self._FILL, (11, filters), (8, struct.pack("<BBBQ3I", 3, 2, 3, tree, rows, columns, 8)))

    def _tree(self, kind: int, entries: list[tuple[bytes, int]], end: bytes, k: int) -> int:
        """A version 1 tree over entries (the key left of each, its address)."""
        level = 0
        while True:
            up, groups = [], [entries[i : i + 2 * k] for i in range(0, len(entries), 2 * k)]
            room = 24 + 2 * k * (len(end) + 8) + len(end)
            here = [self.size + i * len(padded(bytes(room))) for i in range(len(groups))]
            for i, group in enumerate(groups):
                last = groups[i + 1][0][0] if i + 1 < len(groups) else end
                beside = (here[i - 1] if i else NONE, here[i + 1] if i + 1 < len(groups) else NONE)
                node = struct.pack("<4sBBHQQ", b"TREE", kind, level, len(group), *beside) + b"".join(key + struct.pack("<Q", to) for key, to in group) + last
                up.append((group[0][0], self.put(node + bytes(room - len(node)))))
            if len(up) == 1:
                return up[0][1]
            entries, level = up, level + 1

    def group(self, members: dict[str, int]) -> int:
        return self._group(members)[0]

    def _group(self, members: dict[str, int]) -> tuple[int, int, int]:
        names, offsets, text = sorted(members, key=str.encode), {}, bytes(8)
        for name in names:
            offsets[name] = len(text)
            text += padded(name.encode() + b"\0")
        heap = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(text), 1, self.put(text)))
        entries, before = [], struct.pack("<Q", 0)
        for i in range(0, max(len(names), 1), 2 * LEAF_K):
            part = names[i : i + 2 * LEAF_K]
            node = struct.pack("<4sBxH", b"SNOD", 1, len(part)) + b"".join(struct.pack("<QQII16x", offsets[n], members[n], 0, 0) for n in part)
            entries.append((before, self.put(node + bytes(8 + 80 * LEAF_K - len(node)))))
            before = struct.pack("<Q", offsets[part[-1]] if part else 0)
        tree = self._tree(0, entries, before, GROUP_K)
        return self._header((0x11, struct.pack("<QQ", tree, heap))), tree, heap

    def finish(self, members: dict[str, int]) -> list[bytes]:
        """The whole file, in parts, with these members of the root group."""
        root, tree, heap = self._group(members)
        head = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", LEAF_K, GROUP_K, 0)
        head += struct.pack("<4Q", 0, NONE, self.size, NONE) + struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap)
        self.parts[0] = head
        return self.parts
