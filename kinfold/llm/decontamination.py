"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of both sides become typed placeholders, other words their lower-cased selves; a number with
separators (1,000 or 2.5) and a name of several words are one placeholder. Windows of `window` such words are hashed, and
those of documents meet those of benchmark items in a Spark hash join; a bitmap of bounded size, in which each window of
the benchmark has set a bit, keeps documents' other windows from being shuffled. An item whose windows a document has in a
row (same distance between their places) is aligned with it. Where placeholders are consistent along the alignment, that is the same value of the item always meets
the same value of the document and the other way around, all its windows count. So they do where at least half of its
words are no placeholders and at least half of the placeholders are a number or meet the value that their item's value
meets most often. Of other alignments, windows with the same wording count. An alignment that makes two names one is
another question, and none of its windows count. Alignments of one item with a document go from the longest to the
shortest; one that gives a name another value than an earlier one did has only its windows with the same wording.

A capital at the start of a sentence or line may be a name's or the sentence's, so texts are read in two forms: in
the first such words are words, in the second they are names. A window counts that is found in either form.
Scripts without capitals have no names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as t

# Fixed values.
#: Units that a number may have.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees "
    "mph kmh watt watts volt volts joule joules newton newtons"
).split()
_NUMBER, _NAME, _UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
_DIGIT = t.lut("0123456789")
#: Code points of capitals.
_UPPER = np.array([chr(c).istitle() for c in range(0x20000)])
_SMALL = t.lut("abcdefghijklmnopqrstuvwxyz")
_SMALL[128:] = True
_STOP = t.lut(".!?\n:")
#: Bits of the benchmark's bitmap, at most (as a power of two): 32 MB.
BITMAP = 28
_CHUNK = 1 << 16
#: Forms of a text: names are within sentences only, or may begin them.
FORMS = (0, 1)


@dataclass(frozen=True)
class Template:
    """A text's words in one form, placeholders among them. value: of what stands there, lower-cased; kind: 0 or what a placeholder stands for; token: what windows hash; offs: of texts."""

    value: np.ndarray
    kind: np.ndarray
    token: np.ndarray
    offs: np.ndarray


def _first(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it a capital, its bytes) of the first character of words."""
    lead = data[starts]
    capital, size = _UPPER[lead], np.ones(len(starts), np.int8)
    wide = np.flatnonzero(lead >= 0x80)
    a, b, c, d = (data[np.minimum(starts[wide] + i, len(data) - 1)].astype(np.int64) for i in range(4))
    n = 1 + (a >= 0xC0) + (a >= 0xE0) + (a >= 0xF0)
    b, c, d = b & 63, c & 63, d & 63
    point = np.select([n == 1, n == 2, n == 3], [a, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    capital[wide] = (point < len(_UPPER)) & _UPPER[np.minimum(point, len(_UPPER) - 1)]
    size[wide] = n
    return capital, size


def canonical(data: np.ndarray, offs: np.ndarray) -> list[Template]:
    """The texts in each form."""
    low = t.LOWER[data]
    found = t.words(data, offs, t.ALNUM)
    starts, ends = found.starts, found.ends
    n = len(starts)
    if not n:
        none = np.zeros(0, np.uint64)
        return [Template(none, none, none, np.zeros(len(offs), np.int64)) for _ in FORMS]
    same = np.zeros(n, bool)  # does the word before belong to the same text?
    same[1:] = True
    same[found.offs[:-1][found.offs[:-1] < n]] = False
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    initial = ~same
    initial[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    capital, size = _first(data, starts)
    titled = capital & _SMALL[data[np.minimum(starts + size, len(data) - 1)]] & (ends - starts > size)
    number = _DIGIT[data[starts]]
    between = np.zeros(n, np.uint8)
    between[1:] = np.where(starts[1:] - ends[:-1] == 1, data[np.minimum(ends[:-1], len(data) - 1)], 0)
    before = lambda x: np.concatenate([[False], x[:-1]])
    split = same & number & before(number) & np.isin(between, np.frombuffer(b".,", np.uint8))
    unit = same & before(number) & np.isin(t.word_values(low, found), _unit_values())
    out = []
    for name in (titled & ~initial, titled):
        joined = split | same & name & before(name) & (between == 32)
        at = np.flatnonzero(~joined)
        last = np.append(at[1:], n) - 1
        kind = np.select([unit, number, name], [_UNIT, _NUMBER, _NAME], np.uint64(0))[at]
        words = t.Words(starts[at], ends[last], np.searchsorted(at, found.offs))
        value = t.word_values(low, words)
        out.append(Template(value, kind, np.where(kind > 0, kind, value), words.offs))
    return out


def _unit_values() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(t.word_values(text, t.words(text, np.array([0, len(text)]), t.ALNUM)))


def _windows(own: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the windows that are within one text."""
    every = t.Rolling(own.token).every(size)
    at = np.arange(len(every))
    doc = np.searchsorted(own.offs, at, "right") - 1
    inside = at + size <= own.offs[doc + 1]
    return every[inside], at[inside]


def _values(value: np.ndarray, at: np.ndarray, size: int) -> list[bytes]:
    """The values of windows."""
    rows = value[at[:, None] + np.arange(size)]
    whole, wide = rows.tobytes(), 8 * size
    return [whole[i : i + wide] for i in range(0, len(whole), wide)]


_ITEM = "form byte, size byte, hash long, item_id long, item_tag long, word int, n_windows int, item_value binary, item_kind binary"


def _item_rows(window: int, least: int) -> Callable:
    def work(batches):
        for block in t.blocks(batches, t.BLOCK_BYTES // 4):
            rows: list[list] = [[] for _ in range(9)]
            tags = np.array([int.from_bytes(hashlib.blake2b(block.text(i), digest_size=8).digest(), "little", signed=True) for i in range(len(block.ids))], np.int64)
            for form, own in zip(FORMS, canonical(block.data, block.offs), strict=True):
                sizes = np.diff(own.offs)
                for size in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
                    hashes, at = _windows(own, size)
                    doc = np.searchsorted(own.offs, at, "right") - 1
                    use = (np.minimum(sizes[doc], window) == size) & (sizes[doc] >= least)
                    hashes, at, doc = hashes[use], at[use], doc[use]
                    parts = (np.full(len(at), form), np.full(len(at), size), hashes.view(np.int64), block.ids[doc], tags[doc], at - own.offs[doc], sizes[doc] - size + 1)
                    for column, part in zip(rows, (*(p.tolist() for p in parts), _values(own.value, at, size), _values(own.kind, at, size)), strict=True):
                        column += part
            types = (pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(rows, types, strict=True)], names=[c.split()[0] for c in _ITEM.split(", ")])

    return work


def _chunk_rows(bits: int) -> Callable:
    def work(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for c, (own,) in X.split((place // np.uint64(8 * _CHUNK)).astype(np.int64), place % np.uint64(8 * _CHUNK)):
                held = chunks.setdefault(c, np.zeros(_CHUNK, np.uint8))
                np.bitwise_or.at(held, (own >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (own & np.uint64(7))).astype(np.uint8))
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], names=["chunk", "bits"])

    return work


def _united(group: pa.Table) -> pa.Table:
    held = np.zeros(_CHUNK, np.uint8)
    for x in group.column("bits"):
        held |= np.frombuffer(x.as_buffer(), np.uint8)
    return pa.table([group.column("chunk")[:1], pa.array([held.tobytes()], pa.binary())], names=["chunk", "bits"])


def _bitmap(items: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit for each window's hash, by its leading bits; as many as BITMAP allows."""
    bits = min(BITMAP, max(19, int(count).bit_length() + 5))
    held = np.zeros((1 << bits) // 8, np.uint8)
    made = items.select("hash").mapInArrow(_chunk_rows(bits), "chunk int, bits binary")
    for r in made.groupBy("chunk").applyInArrow(_united, "chunk int, bits binary").toLocalIterator():
        held[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.bits, np.uint8)
    return held, bits


_HIT = "row long, doc_id long, text_sha256 binary, form byte, size byte, hash long, at int, doc_value binary"


def _doc_rows(bitmap, bits: int, kinds: list[tuple[int, int]]) -> Callable:
    """Windows of documents that may be the benchmark's."""

    def work(batches):
        known, row = bitmap.value, TaskContext.get().partitionId() << 40
        for block in t.blocks(batches):
            forms = canonical(block.data, block.offs)
            rows: list[list] = [[] for _ in range(8)]
            digests: dict[int, bytes] = {}
            for form, size in kinds:
                own = forms[form]
                every, at = _windows(own, size)
                place = every >> np.uint64(64 - bits)
                some = np.flatnonzero(known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                every, at = every[some], at[some]
                doc = np.searchsorted(own.offs, at, "right") - 1
                for d in np.unique(doc).tolist():
                    if d not in digests:
                        digests[d] = hashlib.sha256(block.text(d)).digest()
                ids = [None if block.id_null[d] else int(block.ids[d]) for d in doc.tolist()]
                parts = ((row + doc).tolist(), ids, [digests[d] for d in doc.tolist()], [form] * len(at), [size] * len(at), every.view(np.int64).tolist(), (at - own.offs[doc]).tolist(), _values(own.value, at, size))
                for column, part in zip(rows, parts, strict=True):
                    column += part
            row += len(block.ids)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int8(), pa.int8(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(rows, types, strict=True)], names=[c.split()[0] for c in _HIT.split(", ")])

    return work


def _consistent(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> bool:
    """Does each placeholder's value meet one value of the other side, both ways?"""
    to, back = {}, {}
    for k, x, y in zip(kind.tolist(), a.tolist(), b.tolist(), strict=True):
        if to.setdefault((k, x), y) != y or back.setdefault((k, y), x) != x:
            return False
    return True


def _majority(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> dict[tuple[int, int], int]:
    """The other side's value that each placeholder's value meets most often; of equally many its own, then the first one."""
    met: dict[tuple[int, int], dict[int, int]] = {}
    for k, x, y in zip(kind.tolist(), a.tolist(), b.tolist(), strict=True):
        own = met.setdefault((k, x), {})
        own[y] = own.get(y, 0) + 1
    return {key: max(own, key=lambda y: (own[y], y == key[1])) for key, own in met.items()}


def _counted(a: np.ndarray, b: np.ndarray, kind: np.ndarray, name: np.ndarray) -> str:
    """Which windows of an alignment count: all, same (those with the same wording) or none. name: is it one wherever it stands?"""
    slot = kind > 0
    if _consistent(a[slot], b[slot], kind[slot]):
        return "all"
    to = _majority(a[slot], b[slot], kind[slot])
    names = [to[int(_NAME), x] for x in set(a[name].tolist())]
    if len(set(names)) < len(names):
        return "none"
    agree = sum(k == _NUMBER or to[k, x] == y for k, x, y in zip(kind[slot].tolist(), a[slot].tolist(), b[slot].tolist(), strict=True))
    return "all" if 2 * slot.sum() <= len(slot) and 2 * agree >= slot.sum() else "same"


FOUND = "row long, doc_id long, text_sha256 binary, item_id long, n_windows long, coverage double, same_wording boolean"


def _told(hits: list[dict], share: float) -> dict | None:
    """hits of one document and item: does the document have the item?"""
    aligned: dict[tuple[int, int], dict[int, tuple[int, bytes, bytes, bytes]]] = {}
    for h in hits:
        aligned.setdefault((h["at"] - h["word"], h["form"]), {})[h["word"]] = h["size"], h["item_value"], h["doc_value"], h["item_kind"]
    seen: set[int] = set()
    same = True
    to: dict[tuple[int, int], int] = {}
    within = {x for (_, form), own in aligned.items() if not form for _, a, _, k in own.values() for x in np.frombuffer(a, np.uint64)[np.frombuffer(k, np.uint64) == _NAME].tolist()}
    for _, own in sorted(aligned.items(), key=lambda x: (-len(x[1]), x[0])):
        words: dict[int, tuple[int, int, int]] = {}
        for word, (_, a, b, k) in own.items():
            words.update(zip(range(word, word + len(a) // 8), zip(*(np.frombuffer(x, np.uint64).tolist() for x in (a, b, k)), strict=True), strict=True))
        a, b, kind = (np.array(c, np.uint64) for c in zip(*(words[w] for w in sorted(words)), strict=True))
        counted = _counted(a, b, kind, (kind == _NAME) & (np.isin(a, list(within)) if within else True))
        slot = kind == _NAME
        names = _majority(a[slot], b[slot], kind[slot])
        if counted == "all" and any(to.get(key, value) != value for key, value in names.items()):
            counted = "same"
        if counted == "none":
            continue
        at = set(own) if counted == "all" else {word for word, (_, x, y, _) in own.items() if x == y}
        if at:
            if counted == "all":
                to = names | to
            seen |= at
            same &= bool((a == b).all())
    part = len(seen) / hits[0]["n_windows"]
    return {"n_windows": len(seen), "coverage": part, "same_wording": same} if seen and part >= share else None


def _judged(share: float) -> Callable:
    """Hits, sorted by document and item, to what is found; a document and item may go on in the next batch."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())

    def work(batches):
        held: list[dict] = []

        def settle(hits: list[dict]) -> Iterator[dict]:
            if hits and (told := _told(hits, share)):
                yield told | {c: hits[0][c] for c in ("row", "doc_id", "text_sha256", "item_id")}

        for batch in batches:
            out = []
            for h in batch.to_pylist():
                if held and any(held[0][c] != h[c] for c in ("row", "item_id", "item_tag")):
                    out += settle(held)
                    held = []
                held.append(h)
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], x) for c, x in zip(names, types, strict=True)], names=names)
        out = list(settle(held))
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], x) for c, x in zip(names, types, strict=True)], names=names)

    return work


def _found(docs: DataFrame, benchmark: DataFrame, window: int, share: float, least: int, slice_items: int) -> DataFrame:
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    slices = max(1, -(-asked.count() // slice_items))
    out = None
    for k in range(slices):
        own = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k)
        items = X.kept(own.mapInArrow(_item_rows(window, least), _ITEM))
        per = items.groupBy("form", "size").count().collect()
        bitmap, bits = _bitmap(items, sum(r["count"] for r in per))
        sent = spark.sparkContext.broadcast(bitmap)
        hits = docs.mapInArrow(_doc_rows(sent, bits, sorted((r.form, r.size) for r in per)), _HIT).join(items, ["hash", "form", "size"])
        found = hits.repartition("row").sortWithinPartitions("row", "item_id", "item_tag").mapInArrow(_judged(share), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.3, least: int = 4, slice_items: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, same_wording): documents that hold an item of the benchmark, perhaps with other numbers, names or units.

    benchmark: (item_id, text). share: of an item's windows that a document has to have, at least. An item shorter than
    `window` words is one window; one of fewer than `least` words, null or empty is never found; rows of one item_id and
    other texts are different items. slice_items: items whose windows share a bitmap, at most; more take a pass each.
    What is sent to the driver and broadcast is the bitmap, of 32 MB at most.

    Null text: nothing is found; rows with a null id are not told. A row that is repeated is told as often; an item that
    is repeated under other ids is told for each. Other columns are not read. Either table empty: no rows.
    """
    found = _found(t.id_text(docs, id_col, text_col), benchmark, window, share, least, slice_items)
    return found.where("doc_id IS NOT NULL").select("doc_id", "item_id", "n_windows", "coverage", "same_wording")


def without(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.3, least: int = 4, slice_items: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts hold no item. Rows are told by their texts alone, so null and repeated ids don't matter; null texts stay."""
    gone = _found(t.id_text(docs, id_col, text_col), benchmark, window, share, least, slice_items).select(F.hex("text_sha256").alias("_kinfold_sha256")).distinct()
    key = F.coalesce(F.upper(F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)), F.lit(""))
    return docs.join(gone, key == F.col("_kinfold_sha256"), "left_anti")
