"""Byte-pair encoding with a pair occurrence index, and decoding.

A task splits its texts into pretokens, numbers the distinct ones it has not met, and encodes all
new ones of a batch together: their bytes stand in one array with links to the neighbours, and an
index maps each mergeable pair to all its positions. A heap holds the ranks that occur; the
smallest is taken, merged at all its valid positions at once (overlaps from left to right), and
the pairs that arise are added to their lists. Positions that an earlier merge has used up are
recognised when their list is taken. A text is then its pretokens' ids in order.

Defined results: a null or empty text has no ids; the strings of added tokens become those tokens,
as the library does by default; repeated rows are encoded alike; ids that the vocabulary lacks
raise; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .tokenizer_files import default_path

#: Characters of text that are split at once, bytes of pretokens in one index, and distinct pretokens that a
#: task remembers before it starts anew.
SPLIT_CHARS, INDEX_BYTES, REMEMBER = 1 << 20, 1 << 21, 1 << 18


def byte_letters() -> dict[str, int]:
    """Byte-level files write each byte as one letter: printable ones as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by rank, the bytes of each id, and the added tokens of a byte-level file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        made_at = {m: r for r, m in enumerate(self.made.tolist())}
        if any(max(made_at.get(a, -1), made_at.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))):
            raise ValueError("a merge uses a token that only a later merge makes")
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        key = self.left.astype(np.int64) << 32 | self.right
        self._order = np.argsort(key)
        self._keys = key[self._order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none merges."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """All positions of each mergeable pair among some sequences of bytes."""

    def __init__(self, vocab: Vocabulary, pieces: list[bytes]):
        self.v = vocab
        self.ends = np.cumsum([len(p) for p in pieces])
        self.sym = vocab.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(self.sym)
        self.next, self.prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.next[self.ends - 1] = -1
        self.prev[np.r_[0, self.ends[:-1]]] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0).astype(np.int32))

    def _add(self, at: np.ndarray) -> None:
        rank = self.v.ranks(self.sym[at], self.sym[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heapq.heappush(self.active, r)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many of each piece)."""
        sym, nxt, prev, v = self.sym, self.next, self.prev, self.v
        while self.active:
            r = heapq.heappop(self.active)
            parts = self.lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = v.left[r], v.right[r]
            at = at[sym[at] == a]
            right = nxt[at]
            good = (right >= 0) & (sym[right] == b)
            at = at[good]
            if len(parts) > 1 or a == b:
                at = np.unique(at)
            right = nxt[at]
            if a == b and len(at) > 1:
                begins = np.r_[True, at[1:] != right[:-1]]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at, right = at[since % 2 == 0], right[since % 2 == 0]
            if not len(at):
                continue
            after = nxt[right]
            sym[at], sym[right] = v.made[r], -1
            nxt[at] = after
            prev[after[after >= 0]] = at[after >= 0]
            before = prev[at]
            self._add(np.concatenate([before[before >= 0], at[after >= 0]]))
        alive = sym >= 0
        total = np.r_[0, np.cumsum(alive)]
        return sym[alive], np.diff(total[np.r_[0, self.ends]])


class Encoder:
    """Ids of texts; remembers the pretokens it has met."""

    def __init__(self, path: str):
        import public_tokenizers

        self.v = vocabulary(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.added, key=len, reverse=True)))) if self.v.added else None
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _pretokens(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def _learn(self, new: list[str]) -> None:
        at, size = 0, 0
        for i, p in enumerate(new):
            size += len(p)
            if size > INDEX_BYTES or i + 1 == len(new):
                self._learn_some(new[at : i + 1])
                at, size = i + 1, 0

    def _learn_some(self, new: list[str]) -> None:
        plain = [p for p in new if p not in self.v.added]
        ids, n = PairIndex(self.v, [p.encode() for p in plain]).run() if plain else (np.empty(0, np.int32), np.empty(0, np.int64))
        if len(plain) < len(new):
            ends, parts, count, k = np.cumsum(n), [], [], 0
            for p in new:
                if p in self.v.added:
                    parts.append(np.array([self.v.added[p]], np.int32))
                else:
                    parts.append(ids[ends[k] - n[k] : ends[k]])
                    k += 1
                count.append(len(parts[-1]))
            ids, n = np.concatenate(parts), np.array(count)
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of successive parts of texts."""
        if len(self.code) > REMEMBER:
            self._forget()
        code, parts, at = self.code, [], 0
        known = len(code)
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < SPLIT_CHARS):
                size += len(texts[upto])
                upto += 1
            tokens = [self._pretokens(t) for t in texts[at:upto]]
            counts = np.array([len(t) for t in tokens])
            flat = np.fromiter((code.setdefault(p, len(code)) for t in tokens for p in t), np.int32, int(counts.sum()))
            parts.append((flat, counts))
            at = upto
        if len(code) > known:
            self._learn(list(islice(code, known, None)))
        out = []
        for flat, counts in parts:
            n = (self.starts[flat + 1] - self.starts[flat]) if len(flat) else np.empty(0, np.int64)
            ends = np.cumsum(n)
            pick = np.repeat(self.starts[flat] - (ends - n), n) + np.arange(n.sum())
            out.append((self.flat[pick], np.r_[0, ends][np.r_[0, np.cumsum(counts)]]))
        return out


def _texts(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    return [b"".join(map(vocab.bytes_of.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _encode(path: str, back: bool):
    """Ids of each text and, if asked, the text that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            at = 0
            for ids, offsets in enc.encode(batch.column(1).to_pylist()):
                n = len(offsets) - 1
                cols = [batch.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(_texts(enc.v, ids, offsets), pa.string())] * back, names=["doc_id", "ids", "text"][: 2 + back])
                at += n

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            texts = _texts(vocabulary(path), np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_encode(path or default_path(), False), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, text) as decode(encode(docs)) gives them, in one worker."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_encode(path or default_path(), True), f"doc_id {kind}, ids array<int>, text string")


def query(spark, sf_dir) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
