"""Exact dedup of byte strings by prefix-free parsing: bytes of strings that start earlier in the corpus are removed.

Texts are parsed into phrases that end at triggers: `seed`-byte strings whose rolling hash is 0 modulo `period`. A
`length`-byte string without one has as trigger the one of its `seed`-byte strings with the least hash, so that every
string has a first trigger that depends on its bytes alone, and no suffix of a phrase is a prefix of another's. A string is
then a suffix of the phrase that ends at its first trigger, followed by a prefix of the parse that comes after. The
dictionary's suffix array ranks the former, the parse's suffix array the latter; both together give the corpus order
of the strings, in which equal ones are neighbours and all but the first of them are removed. The order is kept in parts:
strings with the same first trigger are in the same part.

1. `_phrase_rows`: what a string can reach on both sides of its trigger is the trigger's context (phrase and parse, cut
   at `length`). Contexts with the same cryptographic digest (of 96 bits) are one entry; `_meet` finds the first of each. All
   strings of the others' are repeats. A trigger with one entry only has nothing left to compare.
2. `_local`: entries of triggers with several are read from the documents. Each task sorts its own dictionary of phrases
   and its own parse into suffix arrays, drops the strings that aren't the first of their kind, and sends the rest on:
   whole entries, by what all their strings share (two thirds of a string's bytes, so that a frequent trigger doesn't
   fill a bucket), or, where a task has several entries of the same key, their strings singly by digest.
3. `_combine`: the suffix arrays of the tasks' entries, which tells the first of equal strings; `_settle` does so for
   single ones, of which a task sends one of each kind.
4. `_finish`: the bytes that repeated strings cover are removed.

Only the order within a part is made: a global one of a mostly unique corpus would have to move a row a byte.
The order of a task's input doesn't matter for the result, so that tasks can run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import corpus as C
from . import exchange as X
from . import text as t

_ENTRY, _BRANCH, _NOTE, _SUFFIX, _MIXED, _STRING = range(6)
#: Strings that a note is about at most.
_MOST = 255


@dataclass(frozen=True)
class Rule:
    """length: bytes of a string; seed: of a trigger; period: mean bytes of a phrase; chunk: entries that a task merges at once; rows: of a suffix array."""

    length: int = 100
    seed: int = 32
    period: int = 64
    chunk: int = 1_000_000
    rows: int = 40_000

    @property
    def reach(self) -> int:
        """A string starts this far before its trigger at most."""
        return self.length - self.seed

    @property
    def half(self) -> int:
        """Strings that start up to this far before the trigger share as many bytes behind it; others before it."""
        return self.reach // 2


class Entries(NamedTuple):
    """Triggers and digests of their contexts. start, count: of the strings with this trigger; back: from the first start to the trigger."""

    start: np.ndarray
    trigger: np.ndarray
    one: np.ndarray
    two: np.ndarray
    count: np.ndarray
    back: np.ndarray
    ids: np.ndarray
    tags: np.ndarray

    def pick(self, at: np.ndarray) -> Entries:
        return Entries(*(c[at] for c in self))


def _parse(data: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(hash, place, first start of its strings, number of starts, end of its context, text) of all triggers."""
    none = np.zeros(0, np.int64)
    every = t.Rolling(t.byte_values()[data]).every(rule.seed)
    if not len(every):
        return np.zeros(0, np.uint64), none, none, none, none, none
    ends = np.repeat(offs[1:], np.diff(offs))[: len(every)]
    place = np.arange(len(every))
    trigger = (every % np.uint64(rule.period) == 0) & (place + rule.seed <= ends)
    phrase = np.flatnonzero(trigger)
    text = np.searchsorted(offs, phrase, "right") - 1
    before = np.concatenate([[-1], phrase[:-1]])[: len(phrase)]
    first = np.maximum(np.maximum(before + 1, phrase - rule.reach), offs[text])
    if len(every) > rule.reach:
        seen = np.concatenate([[0], np.cumsum(trigger)])
        n = len(every) - rule.reach
        free = (seen[rule.reach + 1 :] == seen[:n]) & (place[:n] + rule.length <= ends[:n])
        order = (every >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = np.where(free, t.sliding(order, rule.reach + 1, True), np.uint32(0))
        padded = np.zeros(n + 2 * rule.reach, np.uint32)
        padded[rule.reach : rule.reach + n] = least
        other = np.flatnonzero((t.sliding(padded, rule.reach + 1, False) == order) & ~trigger)
        own = np.searchsorted(offs, other, "right") - 1
        first = np.concatenate([first, np.maximum(other - rule.reach, offs[own])])
        phrase, text = np.concatenate([phrase, other]), np.concatenate([text, own])
    last = np.minimum(phrase, offs[text + 1] - rule.length)
    use = first <= last
    phrase, text, first, last = phrase[use], text[use], first[use], last[use]
    return every[phrase], phrase, first, last - first + 1, np.minimum(phrase + rule.length, offs[text + 1]), text


def _same(trigger, one, two, ids, tags, start, branches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of: first entries of triggers with no other entry; of others; entries with an earlier one of the same digest; the others' triggers."""
    order = np.argsort(trigger, kind="stable")
    sizes = np.diff(np.append(np.flatnonzero(t.runs(trigger[order])), len(order)))
    alone = np.repeat(sizes == 1, sizes)
    if len(branches):
        alone &= ~np.isin(trigger[order], branches)
    sole, rest = order[alone], order[~alone]
    if not len(rest):
        return sole, rest, rest, trigger[rest]
    rest = rest[np.lexsort((start[rest], tags[rest], ids[rest], two[rest], one[rest], trigger[rest]))]
    new, kind = t.runs(trigger[rest]), t.runs(trigger[rest], one[rest], two[rest])
    late = ~_leads(kind, ids[rest], tags[rest], start[rest])
    group = np.cumsum(new) - 1
    many = np.bincount(group[kind]) > 1
    if len(branches):
        many |= np.isin(trigger[rest][new], branches)
    return np.concatenate([sole, rest[~late & ~many[group]]]), rest[~late & many[group]], rest[late], trigger[rest][new][many]


def _leads(new: np.ndarray, ids, tags, start) -> np.ndarray:
    """Of sorted rows in groups that begin at `new`: those at the same place as the group's first."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return (ids == ids[lead]) & (tags == tags[lead]) & (start == start[lead])


def _notes(n: int, ids, tags, start, count, back, compare: int) -> Iterator[tuple[int, int, bytes]]:
    cols = tags, start.astype(np.int32), count.astype(np.uint8), back.astype(np.uint8), np.full(len(ids), compare, np.uint8)
    for b, own in X.split(C.of_id(ids, n), *cols):
        yield b, _NOTE, X.pack(own)


def _dealt(kind: int, bucket: np.ndarray, start: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """cols: the last two are ids and tags, which are packed once a document; starts are packed as differences."""
    for b, own in X.split(bucket, start, *cols):
        start, *own, ids, tags = own
        _, at, back = np.unique(tags, return_index=True, return_inverse=True)
        yield b, kind, X.pack((np.diff(start, prepend=0).astype(np.int32), *own, ids[at], tags[at], back.astype(np.uint16 if len(at) < 1 << 16 else np.uint32)))


def _collected(group: pa.Table, kind: int) -> list[np.ndarray] | None:
    parts = [(np.cumsum(start.astype(np.int64)), *own, ids[back], tags[back]) for start, *own, ids, tags, back in X.each(group, kind)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None


def _of_hash(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _told(n: int, e: Entries, branches: np.ndarray, known: bool) -> Iterator[tuple[int, int, bytes]]:
    """What is known of entries. known: are these all entries of their triggers?"""
    sole, compare, late, mixed = _same(e.trigger, e.one, e.two, e.ids, e.tags, e.start, branches)
    if not known:
        own = e.pick(np.sort(sole))
        yield from _dealt(_ENTRY, _of_hash(own.trigger, n), *own)
        for b, (cols,) in X.split(_of_hash(mixed, n), mixed):
            yield b, _BRANCH, X.pack(cols)
    for at, flag in ((compare, 1), (late, 0)):
        own = e.pick(at)
        yield from _notes(n, own.ids, own.tags, own.start, own.count, own.back, flag)


def _phrase_rows(rule: Rule, n: int) -> Callable:
    none = np.zeros(0, np.uint64)

    def work(batches):
        held: list[Entries] = []
        size = 0

        def flush():
            yield from _told(n, Entries(*(np.concatenate(c) for c in zip(*held, strict=True))), none, False)

        def found():
            nonlocal held, size
            for block in t.blocks(batches):
                trigger, at, first, count, end, text = _parse(block.data, block.offs, rule)
                if not len(at):
                    continue
                view = block.data.tobytes()
                digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                one, two = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
                one = one ^ t.mix(((at - first) * 1024 + (end - at)).astype(np.uint64))
                ids = C.keys(block)
                tags = C.tags(block.data, block.offs, ids)
                held.append(Entries(first - block.offs[text], trigger, one, (two >> np.uint64(32)).astype(np.uint32), count.astype(np.uint8), (at - first).astype(np.uint8), ids[text], tags[text]))
                size += len(at)
                if size >= rule.chunk:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows(found())

    return work


def _meet(n: int) -> Callable:
    def work(group: pa.Table) -> pa.Table:
        out = X.passed(group, _NOTE)
        if found := _collected(group, _ENTRY):
            branches = np.unique(np.concatenate([np.zeros(0, np.uint64), *X.each(group, _BRANCH)]))
            out += _told(n, Entries(*found), branches, True)
        return X.table(out)

    return work


class Strings(NamedTuple):
    """Rows of a suffix array's two sides: `left` (bytes before the trigger, backwards), `right` (the trigger and what follows), and which
    strings are asked about: open[i, j] the one that starts j bytes before the trigger, or j + 1 + half for those of the other side."""

    key: np.ndarray
    left: np.ndarray
    right: np.ndarray
    open: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    tags: np.ndarray

    def pick(self, which: np.ndarray) -> Strings:
        return Strings(*(c[which] for c in self))


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: the order of byte rows, and how many bytes each shares with the one before it."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order = np.lexsort(wide.view(">u8").T[::-1]) if len(rows) else np.zeros(0, np.int64)
    own = rows[order]
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = np.ones((len(rows) - 1, rows.shape[1] + 1), bool)
        differ[:, :-1] = own[1:] != own[:-1]
        shared[1:] = differ.argmax(1)
    return order, shared


def _repeats(s: Strings, rule: Rule, base: int) -> np.ndarray:
    """Which of the open strings an earlier one equals. base: 0 for strings that start up to `half` before the trigger, or half + 1."""
    late = np.zeros(s.open.shape, bool)
    dictionary, shared_left = _ranked(s.left)
    parse, shared_right = _ranked(s.right)
    rank = np.empty(len(parse), np.int64)
    rank[parse] = np.arange(len(parse))
    phrase = np.empty(len(parse), np.int64)
    follow = np.empty(len(parse), np.int64)
    for j in range(s.open.shape[1]):
        rows = np.flatnonzero(s.open[:, j])
        if len(rows) < 2:
            continue
        phrase[dictionary] = np.cumsum(shared_left < base + j)
        follow[parse] = np.cumsum(shared_right < rule.length - base - j)
        rows = rows[np.argsort(phrase[rows] * len(parse) + rank[rows])]  # the corpus order: by phrase suffix, then by the parse
        new = t.runs(phrase[rows], follow[rows])
        group = np.cumsum(new) - 1
        some = np.bincount(group)[group] > 1
        rows, group = rows[some], group[some]
        if len(rows):
            rows = rows[np.lexsort((s.at[rows], s.tags[rows], s.ids[rows], group))]
            late[rows[~_leads(t.runs(group), s.ids[rows], s.tags[rows], s.at[rows])], j] = True
    return late


def _by_key(s: Strings, rule: Rule) -> Iterator[Strings]:
    """Parts of bounded size; rows of a key stay together."""
    s = s.pick(np.argsort(s.key, kind="stable"))
    starts = np.append(np.flatnonzero(t.runs(s.key)), len(s.key))
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + rule.rows, "right")) - 1)
        yield s.pick(np.arange(starts[i], starts[j]))
        i = j


def _gone(n: int, s: Strings, late: np.ndarray, base: int) -> Iterator[tuple[int, int, bytes]]:
    row, j = np.nonzero(late)
    yield from _gone_at(n, s.ids[row], s.tags[row], s.at[row] - base - j)


def _gone_at(n: int, ids: np.ndarray, tags: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Notes of repeats, of which those with consecutive starts are one."""
    if not len(ids):
        return
    order = np.lexsort((start, tags))
    ids, tags, start = ids[order], tags[order], start[order].astype(np.int64)
    new = t.runs(tags)
    new[1:] |= start[1:] > start[:-1] + 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    which, part = C.pick(np.zeros(len(at), np.int64), (start[last] - start[at]) // _MOST + 1)
    first = start[at][which] + part * _MOST
    yield from _notes(n, ids[at][which], tags[at][which], first, np.minimum(start[last][which] - first + 1, _MOST), np.zeros(len(which), np.uint8), 0)


def _singly(n: int, s: Strings, open_: np.ndarray, rule: Rule, base: int) -> Iterator[tuple[int, int, bytes]]:
    """Strings by digest."""
    row, j = np.nonzero(open_)
    if not len(row):
        return
    left, right = s.left[:, ::-1].tobytes(), s.right.tobytes()
    wide, far = s.left.shape[1], s.right.shape[1]
    digests = b"".join([blake2b(left[(i + 1) * wide - k : (i + 1) * wide] + right[i * far : i * far + rule.length - k], digest_size=16).digest() for i, k in zip(row.tolist(), (j + base).tolist(), strict=True)])
    one, two = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    start, ids, tags = s.at[row] - base - j, s.ids[row], s.tags[row]
    order = np.lexsort((start, tags))
    yield from _dealt(_STRING, _of_hash(one, n)[order], *(c[order] for c in (start, one, (two >> np.uint64(32)).astype(np.uint32), ids, tags)))


def _sides(rule: Rule) -> tuple[tuple[int, int, int, int], ...]:
    """(first distance of a start from the trigger, number of distances, bytes needed before the trigger, from the trigger on) of the two sides."""
    return (0, rule.half + 1, rule.half, rule.length), (rule.half + 1, rule.reach - rule.half, rule.reach, rule.length - rule.half - 1)


def _local(rule: Rule, n: int) -> Callable:
    """Texts and notes in; out: repeats, and the entries that other tasks' have to be compared with."""

    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        notes = X.blobs(noted, _NOTE)
        if not notes:
            return X.table([])
        bucket = noted.column("bucket")[0].as_py()
        tags, start, count, back, compare = (np.concatenate(c) for c in zip(*notes, strict=True))
        order = np.argsort(tags, kind="stable")
        tags, start, count, back, compare = tags[order], start[order].astype(np.int64), count[order].astype(np.int64), back[order].astype(np.int64), compare[order] > 0
        out = [(bucket, _NOTE, X.pack((tags[~compare], start[~compare].astype(np.int32), count[~compare].astype(np.uint8), back[~compare].astype(np.uint8), compare[~compare].astype(np.uint8))))]
        wanted, seen = np.unique(tags[compare]), set()
        made: tuple[list, list] = ([], [])
        for docs in C.documents(texts):
            mine = [i for i in np.flatnonzero(np.isin(docs.tags, wanted)).tolist() if (key := (int(docs.ids[i]), int(docs.tags[i]))) not in seen and not seen.add(key)]
            if not mine:
                continue
            offs, data = docs.offs, np.concatenate([np.zeros(rule.reach, np.uint8), docs.data, np.zeros(rule.length, np.uint8)])
            mine = np.array(mine)
            which, at = C.pick(np.searchsorted(tags, docs.tags[mine]), np.searchsorted(tags, docs.tags[mine], "right"))
            doc, first = mine[which], start[at] + offs[mine[which]]
            fits = first + count[at] - 1 + rule.length <= offs[doc + 1]  # else it is of another text with this tag
            known = C.covered(len(docs.data) + 1, first[fits & ~compare[at]], (first + count[at])[fits & ~compare[at]])
            use = fits & compare[at]
            doc, first, at = doc[use], first[use], at[use]
            trigger = first + back[at]
            rolling = t.Rolling(t.byte_values()[docs.data])
            for side, (base, wide, before, after) in zip(made, _sides(rule), strict=True):
                starts = trigger[:, None] - base - np.arange(wide)
                open_ = (starts >= first[:, None]) & (starts < (first + count[at])[:, None])
                open_ &= ~known[np.maximum(starts, 0)]
                rows = np.flatnonzero(open_.any(1))
                if not len(rows):
                    continue
                p = trigger[rows]
                lo, hi = (p, p + rule.seed + rule.reach - rule.half) if not base else (p - rule.half - 1, p + rule.seed)
                key = t.mix(rolling.of(lo, hi) + np.uint64(base))
                left = data[p[:, None] + rule.reach - 1 - np.arange(before)]
                right = data[p[:, None] + rule.reach + np.arange(after)]
                side.append(Strings(key, left, right, open_[rows], (p - offs[doc[rows]]).astype(np.int64), docs.ids[doc[rows]], docs.tags[doc[rows]]))
        for side, (base, _, _, _) in zip(made, _sides(rule), strict=True):
            if not side:
                continue
            for s in _by_key(Strings(*(np.concatenate(c) for c in zip(*side, strict=True))), rule):
                late = _repeats(s, rule, base)
                out += _gone(n, s, late, base)
                left = s.open & ~late
                rows = np.flatnonzero(left.any(1))
                if not len(rows):
                    continue
                s, left = s.pick(rows), left[rows]
                sizes = np.diff(np.append(np.flatnonzero(t.runs(s.key)), len(rows)))
                sole = np.repeat(sizes == 1, sizes)
                own, bits = s.pick(sole), np.packbits(left[sole], axis=1)
                out += _dealt(_SUFFIX + 10 * (base > 0), _of_hash(own.key, n), own.at, own.key, own.left, own.right, bits, own.ids, own.tags)
                mixed = np.unique(s.key[~sole])
                out += [(b, _MIXED, X.pack(cols)) for b, (cols,) in X.split(_of_hash(mixed, n), mixed)]
                out += _singly(n, s.pick(~sole), left[~sole], rule, base)
        return X.table(out)

    return work


def _combine(rule: Rule, n: int) -> Callable:
    def work(group: pa.Table) -> pa.Table:
        out = X.passed(group, _NOTE)
        mixed = np.unique(np.concatenate([np.zeros(0, np.uint64), *X.each(group, _MIXED)]))
        for base, wide, _, _ in _sides(rule):
            found = _collected(group, _SUFFIX + 10 * (base > 0))
            if not found:
                continue
            at, key, left, right, bits, ids, tags = found
            for s in _by_key(Strings(key, left, right, np.unpackbits(bits, axis=1, count=wide).astype(bool), at, ids, tags), rule):
                some = np.isin(s.key, mixed)
                if some.any():
                    own = s.pick(some)
                    out += _singly(n, own, own.open, rule, base)
                    s = s.pick(~some)
                out += _gone(n, s, _repeats(s, rule, base), base)
        return X.table(out)

    return work


def _settle(n: int) -> Callable:
    """Of single strings with the same digest, all but the first are repeats."""

    def work(local: pa.Table, combined: pa.Table) -> pa.Table:
        out = X.passed(combined, _NOTE)
        if found := _collected(pa.concat_tables([local, combined]), _STRING):
            at, one, two, ids, tags = found
            order = np.lexsort((at, tags, ids, two, one))
            late = order[~_leads(t.runs(one[order], two[order]), ids[order], tags[order], at[order])]
            out += _gone_at(n, ids[late], tags[late], at[late])
        return X.table(out)

    return work


def _finish(rule: Rule) -> Callable:
    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        tags, start, count, _, _ = X.columns(X.blobs(noted, _NOTE), [np.uint64, np.int32, np.uint8, np.uint8, np.uint8])
        order = np.argsort(tags, kind="stable")
        tags, start, count = tags[order], start[order].astype(np.int64), count[order].astype(np.int64)
        parts = []
        for docs in C.documents(texts):
            doc, at = C.pick(np.searchsorted(tags, docs.tags), np.searchsorted(tags, docs.tags, "right"))
            lo = start[at] + docs.offs[doc]
            hi = lo + count[at] - 1 + rule.length
            fits = hi <= docs.offs[doc + 1]
            parts.append(C.removed(docs, C.covered(len(docs.data), lo[fits], hi[fits]), docs.offs, False))
        return pa.concat_tables(parts) if parts else C.no_rows()

    return work


def suffix_dedup(docs: DataFrame, length: int = 100, seed: int = 32, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a `length`-byte string that also starts earlier: in a document with a smaller id, or before it in the same one.

    Returns one row a row of docs: doc_id, n_symbols (bytes of the text in UTF-8), n_removed, spans (maximal
    removed runs, in bytes, end exclusive), kept (the remaining bytes; binary, as a cut can part a character).
    length: up to 255.

    Null text: empty. A null id comes after all others. Rows with the same id and text are the same document
    and get the same result; rows with the same id and other texts are different documents in the order of a
    fingerprint. Texts shorter than `length` stay whole. Other columns are not read. Empty table: no rows.
    """
    rule = rule or Rule(length, seed)
    docs = t.id_text(docs, id_col, text_col)
    n = X.buckets(docs.sparkSession, docs)
    texts = docs.mapInArrow(C.text_rows(n), X.SCHEMA)
    found = X.by_bucket(docs.mapInArrow(_phrase_rows(rule, n), X.SCHEMA), _meet(n))
    local = X.with_bucket(texts, found, _local(rule, n))
    found = X.with_bucket(local, X.by_bucket(local, _combine(rule, n)), _settle(n))
    return X.with_bucket(texts, found, _finish(rule), C.OUT)
