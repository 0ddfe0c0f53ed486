"""Column buffers of Arrow text columns as NumPy arrays, and fingerprints of their pieces.

Texts are read in blocks of a few MB, so that what a worker holds follows the block and the longest
single text, never the size of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of text that are looked at together.
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 0x5EED5EED


class Block(NamedTuple):
    """Some consecutive texts: their ids, and their UTF-8 bytes end to end."""

    ids: np.ndarray
    id_null: np.ndarray
    null: np.ndarray
    data: np.ndarray
    offs: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names; further columns don't matter."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Splits batches of (doc_id, text) so that a block has `limit` bytes at most, or one text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, texts = batch.column(0), batch.column(1)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        id_null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            j = min(j, n)
            yield Block(ids[i:j], id_null[i:j], null[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j


def beside(docs: DataFrame, work: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with further columns: those that `work`, a function of batches of (id, text) with a row for each row, gives after the id.

    schema: of all that `work` gives, the id first. prefix: of the new columns' names, where docs may have them. Rows meet what was made of them in the task itself, without a join.
    They leave with each batch that `work` gives, so that what a task holds besides what it reads follows those; a text goes to the worker once.
    """
    own = len(docs.columns)
    made = [StructField(prefix + f.name, f.dataType) for f in StructType.fromDDL(schema).fields[1:]]
    fed, places = docs.select("*"), []
    for name, kind in ((id_col, LongType()), (text_col, StringType())):
        if docs.columns.count(name) == 1 and docs.schema[name].dataType == kind:
            places.append(docs.columns.index(name))
        else:
            places.append(len(fed.columns))
            fed = fed.select("*", F.col(f"`{name}`").cast(kind).alias(f"_kinfold_{len(places)}"))
    out = StructType([*docs.schema.fields, *made])

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def feed():
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield pa.RecordBatch.from_arrays([batch.column(p) for p in places], names=["doc_id", "text"])

        at = 0
        for part in work(feed()):
            rows = waiting[0].slice(at, part.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns[:own], *part.columns[1:]], names=out.names)
            at += part.num_rows
            if at == waiting[0].num_rows:
                waiting.pop(0)
                at = 0

    return fed.mapInArrow(run, out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(8)
def byte_values(salt: int = 0) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_SEED + 977 * salt))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have


class Rolling:
    """Fingerprints of any stretches of a sequence of 64-bit values, each from two lookups."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        up, self.down = powers(n, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def every(self, w: int) -> np.ndarray:
        """Of all stretches of w values, by start."""
        n = len(self.sums) - w
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[w:] - self.sums[:-w]) * self.down[:n])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def lut(chars: str) -> np.ndarray:
    """True at the bytes of `chars`."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode("latin-1"), np.uint8)] = True
    return out


#: [^\x20\x09-\x0D]
SPACED = ~lut(" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text; here A-Z count as a-z
ALNUM = lut("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM[128:] = True
#: A-Z to a-z, other bytes to themselves
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """starts and ends in the block's bytes; offs: of each text's words."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = SPACED) -> Words:
    """Maximal runs of bytes that `inside` has; none crosses from one text to the next."""
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = inside[data]
    begin = mask[:-1].copy()
    begin[1:] &= ~mask[:-2]
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(data)]
    begin[cuts] = mask[cuts]
    starts = np.flatnonzero(begin)
    last = mask[:-1] & ~mask[1:]
    cut = cuts[cuts > 0]
    last[cut - 1] = mask[cut - 1]
    ends = np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def word_values(data: np.ndarray, found: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word: of up to 8 bytes one to one with them, given the length; of more, xxh3."""
    starts, size = found.starts, found.ends - found.starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))[starts]
    unused = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
    eight = (eight << unused) >> unused
    out = mix(mix(eight + np.uint64(_SEED + 977 * salt)) + size.astype(np.uint64) * np.uint64(_BASE))
    long = np.flatnonzero(size > 8)
    if len(long):
        view, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(view[a:b], salt) for a, b in zip(starts[long].tolist(), found.ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or largest value of every w neighbours, by start."""
    op = np.minimum if least else np.maximum
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n], x[w - have : w - have + n])


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before it."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            out[1:] |= k[1:] != k[:-1]
    return out
