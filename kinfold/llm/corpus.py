"""Texts by the bucket of their ids, and removal of what notes say about them.

A note is about one document, named by its id and a fingerprint of its text, so that rows that repeat an id keep apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from . import exchange as X
from . import text as t

TEXT = 100
LAST_ID = np.iinfo(np.int64).max
OUT = "doc_id long, n_symbols long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Docs(NamedTuple):
    ids: np.ndarray
    id_null: np.ndarray
    tags: np.ndarray
    offs: np.ndarray
    data: np.ndarray


def keys(block: t.Block) -> np.ndarray:
    """Ids to sort by; null comes last."""
    return np.where(block.id_null, LAST_ID, block.ids)


def tags(data: np.ndarray, offs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A fingerprint of each id and text."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(blake2b(view[a:b], digest_size=8).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64) ^ t.mix(ids.astype(np.int64).view(np.uint64))


def of_id(ids: np.ndarray, n: int) -> np.ndarray:
    return (t.mix(np.ascontiguousarray(ids).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def text_rows(n: int, limit: int = 16 << 20) -> Callable:
    """Work that deals texts out by the bucket of their ids."""

    def work(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            ids, null, marks, lens = (np.concatenate(c) for c in zip(*(x[:4] for x in held), strict=True))
            data = np.concatenate([x[4] for x in held])
            offs = np.concatenate([[0], np.cumsum(lens)])
            for b, (at,) in X.split(of_id(ids, n), np.arange(len(ids))):
                own = np.concatenate([data[offs[i] : offs[i + 1]] for i in at.tolist()])
                yield b, TEXT, X.pack((ids[at], null[at], marks[at], lens[at], own))

        def found():
            nonlocal held, size
            for block in t.blocks(batches):
                ids = keys(block)
                held.append((ids, block.id_null, tags(block.data, block.offs, ids), np.diff(block.offs), block.data.copy()))
                size += len(block.data)
                if size >= limit:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows(found(), 1)

    return work


def documents(group: pa.Table) -> Iterator[Docs]:
    """A bucket's texts, in blocks; one blob is unpacked at a time."""
    for ids, null, marks, lens, data in X.each(group, TEXT):
        offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        i = 0
        while i < len(ids):
            j = min(len(ids), max(i + 1, int(np.searchsorted(offs, offs[i] + t.BLOCK_BYTES, "right")) - 1))
            yield Docs(ids[i:j], null[i:j], marks[i:j], offs[i : j + 1] - offs[i], data[offs[i] : offs[j]])
            i = j


def pick(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places in ranges."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.add.at(edges, hi, -1)
    return np.cumsum(edges[:-1]) > 0


def removed(docs: Docs, gone: np.ndarray, offs: np.ndarray, over_words: bool) -> pa.Table:
    """The operators' rows. gone: of the symbols of all texts end to end, where offs has each text's."""
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    n_removed = total[offs[1:]] - total[offs[:-1]]
    first = np.zeros(len(gone), bool)
    first[:] = gone
    first[1:] &= ~gone[:-1]
    final = gone.copy()
    final[:-1] &= ~gone[1:]
    inner = offs[1:-1]
    begin = inner[inner < len(gone)]
    first[begin] = gone[begin]
    last = inner[inner > 0] - 1
    final[last] = gone[last]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    per = np.searchsorted(starts, offs)
    base = np.repeat(offs[:-1], np.diff(per))
    if over_words:
        data, kept = docs.data.tobytes(), []
        for i, (a, b) in enumerate(zip(docs.offs[:-1].tolist(), docs.offs[1:].tolist(), strict=True)):
            own = data[a:b].split()
            if n_removed[i]:
                own = [w for w, g in zip(own, gone[offs[i] : offs[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(own))
    else:
        stay, cuts = docs.data[~gone].tobytes(), (offs - total[offs]).tolist()
        kept = [stay[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"]))
    ids = pa.array(docs.ids, pa.int64(), mask=docs.id_null)
    return pa.table([ids, pa.array(np.diff(offs)), pa.array(n_removed), spans.cast(_SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_symbols", "n_removed", "spans", "kept"])


def no_rows() -> pa.Table:
    return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.binary())], names=["doc_id", "n_symbols", "n_removed", "spans", "kept"])
