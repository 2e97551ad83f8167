"""Packing token sequences by minimum bin slack.

A document's ids (with its end id) are cut every ``capacity`` ids. Full pieces are sequences of
their own. The remainders are dealt evenly to groups; within a group, each window is seeded with
the longest remainder left and filled by a bounded subset-sum: a bitset (one big integer) holds
the sums that the remaining lengths reach, one step per power-of-two share of a length's count,
and the steps are walked back to the counts used. The same filling is repeated while its counts
last. A text never leaves the task that encodes it; only piece rows are shuffled.

Padding of a sequence is what it lacks to ``capacity``, but nothing at a power of two.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are
packed one by one; a null id is carried along; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .tokenizer_files import default_path, id_encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
#: Remainders that one task packs; a group's waste is one part-filled sequence or two.
GROUP_ROWS = 20_000


def encode_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    rows.append(i)
                    for c, v in zip(cols, (s, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest that fits room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(share, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            share *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths with counts, repetitions) of sequences that use up counts."""
    counts = {k: v for k, v in counts.items() if v}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fill({k: v for k, v in counts.items() if v}, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield used, times


def pack_group(capacity: int):
    def run(key, rows):
        rows = rows.take(pc.sort_indices(rows, [("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        length = rows.column("length").to_numpy()
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sizes, first, n = np.unique(length, return_index=True, return_counts=True)
        at = {int(k): int(i) for k, i in zip(sizes, first, strict=True)}
        k = 0
        for used, times in windows({int(a): int(b) for a, b in zip(sizes, n, strict=True)}, capacity):
            for _ in range(times):
                pos = 0
                for size in sorted(used, reverse=True):
                    for _ in range(used[size]):
                        seq[at[size]], offset[at[size]] = k, pos
                        at[size] += 1
                        pos += size
                k += 1
        base = int(rows.column("g")[0].as_py()) << 32
        return rows.drop_columns(["g"]).append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = materialize(texts.mapInArrow(encode_pieces(path or default_path(), capacity, end_id), f"doc_id {kind}, {PIECES}"))
    groups = -(-max(pieces.count(), 1) // GROUP_ROWS)
    # by the stored row's number, so that equal rows spread too
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack_group(capacity), f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def query(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
