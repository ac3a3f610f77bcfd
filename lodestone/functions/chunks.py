"""Content-defined chunking with a gear hash, vectorised over bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Least, usual and largest chunk, the two masks, and the constants that the gear table is generated from.
LEAST, USUAL, MOST = 2048, 8192, 65536
MASK_BEFORE, MASK_AFTER = 0x0003590703530000, 0x0000D90003530000
SEED, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def gear_table() -> np.ndarray:
    """256 numbers of the splitmix64 stream."""
    out, full = [], (1 << 64) - 1
    for n in range(2, 258):
        z = SEED * n & full
        z = (z ^ z >> 30) * MIX_1 & full
        z = (z ^ z >> 27) * MIX_2 & full
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


GEAR = gear_table()


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of data.

    A shift by one bit for each byte forgets a byte after 64 of them, so the hash at i is a sum over the last 64 gear values;
    within a chunk it starts empty at the least size, and the byte that cuts begins the next chunk.
    """
    ends, start, n = [], 0, len(data)
    while n - start > LEAST:
        stop = min(start + MOST, n)
        gear = GEAR[data[start + LEAST : stop]]
        h = np.zeros(len(gear), np.uint64)
        for k in range(min(64, len(gear))):
            h[k:] += gear[: len(gear) - k] << np.uint64(k)
        usual = min(USUAL, stop - start) - LEAST
        before = np.flatnonzero((h[:usual] & np.uint64(MASK_BEFORE)) == 0)
        if len(before):
            cut = start + LEAST + int(before[0])
        else:
            after = np.flatnonzero((h[usual:] & np.uint64(MASK_AFTER)) == 0)
            cut = start + LEAST + usual + int(after[0]) if len(after) else stop
        ends.append(cut)
        start = cut
    if start < n:
        ends.append(n)
    return ends


def chunk_table(objects: DataFrame) -> DataFrame:
    """digest, ord, start, size, hash of the chunks of every row (digest, content); an empty content has none."""

    def cut(batches):
        for b in batches:
            rows = []
            for digest, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = 0
                for ord_, end in enumerate(cut_points(np.frombuffer(content, np.uint8)) if content else []):
                    rows.append((digest, ord_, start, end - start, hashlib.sha256(content[start:end]).hexdigest()))
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "ord", "start", "size", "hash"])

    return objects.select("digest", "content").mapInArrow(cut, "digest string, ord int, start bigint, size bigint, hash string")
