"""Substring dedup by compaction of a de Bruijn graph: long spans of words that an earlier document has are removed.

Tokens are words. The `length` consecutive words of a window are an edge between the strings of length - 1 words at
its two ends. Only edges that occur in several documents matter, and of those only the ones that branch.

1. `_edge_rows`, `_degrees`: each edge is a row of its fingerprint and its source coordinate (document, place). Rows of
   an edge are aggregated, within a task first. The least coordinate names the edge; other documents' rows are told it.
2. `_paths`: the joined names compact the graph. Where consecutive edges of a document have consecutive names, nothing
   branches between them, and they become one path (document, place, number of edges, name of the first).
3. `_verify`: paths are joined with the documents at their source coordinates, and the words of both are compared by a
   128-bit cryptographic digest. Fingerprints need not be collision-free for the result to be right: where words
   differ, the edges of both sides go on singly, keyed by digests of their words (`_single`, `_settle`). An edge that
   its own source has more than once is named as well, for the case that only the fingerprints agree.
4. `_finish`: the words that verified paths cover are removed.

A path is read off its document in one piece, so no pointer doubling over single edges is needed: a round of it would
shuffle every repeated edge once more. No task sends more than one row of an edge (several only where one document
repeats itself, or rows repeat an id), and the paths of a bucket with the same source are one request, so a frequent
passage or a large group of copies never fills a bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import corpus as C
from . import exchange as X
from . import text as t

_EDGE, _NAME, _ASK, _PATH, _YES, _NO, _ONE, _GONE = range(8)


@dataclass(frozen=True)
class Rule:
    """length: words of a window; chunk: words that a task aggregates at once; bits: of an edge's fingerprint beside its bucket."""

    length: int = 13
    chunk: int = 2_000_000
    bits: int = 48


def _firsts(key: np.ndarray, ids: np.ndarray, pos: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the least id of each key; rows of larger ids, and for each of these the key's first row.

    own: the least id's further rows are among the latter too, in case that they only share the fingerprint.
    """
    order = np.argsort(key, kind="stable")
    new = t.runs(key[order])
    sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
    alone = np.repeat(sizes == 1, sizes)
    rest = order[~alone]
    rest = rest[np.lexsort((pos[rest], ids[rest], key[rest]))]
    lead = np.maximum.accumulate(np.where(t.runs(key[rest]), np.arange(len(rest)), 0)) if len(rest) else rest
    late = ids[rest] > ids[rest[lead]]
    told = late | (np.arange(len(rest)) > lead) if own else late
    return np.concatenate([order[alone], rest[~late]]), rest[told], rest[lead][told]


def _names(n: int, ids, pos, src, at) -> list[tuple[int, int, bytes]]:
    """Notes that an edge of a document has the name (src, at)."""
    return [(b, _NAME, X.pack((i, p.astype(np.int32), s, (a - p).astype(np.int32)))) for b, (i, p, s, a) in X.split(C.of_id(ids, n), ids, pos, src, at)]


def _edge_rows(rule: Rule, n: int) -> Callable:
    top = np.uint64(64 - rule.bits)

    def work(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            key, pos, doc, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            first, late, lead = _firsts(key, ids, pos)
            yield from _names(n, ids[late], pos[late], ids[lead], pos[lead])
            first = np.sort(first)
            key, pos, ids = key[first], pos[first], ids[first]
            own = t.mix(key) % np.uint64(n)
            for b, (k, p, i) in X.split(own.astype(np.int32), key, pos, ids):
                new = t.runs(i)
                at = np.flatnonzero(new)
                wide = (k >> top).view(np.uint8).reshape(len(k), 8)[:, : -(-rule.bits // 8)]
                yield b, _EDGE, X.pack((np.ascontiguousarray(wide), _steps(p, new), i[at], np.diff(np.append(at, len(i))).astype(np.uint32)))

        def found():
            nonlocal held, size
            for block in t.blocks(batches):
                words = t.words(block.data, block.offs)
                every = t.Rolling(t.word_values(block.data, words)).every(rule.length)
                place = np.arange(len(every))
                doc = np.searchsorted(words.offs, place, "right") - 1
                own = place + rule.length <= words.offs[doc + 1]
                if not own.any():
                    continue
                doc = doc[own]
                held.append((every[own], place[own] - words.offs[doc], doc, C.keys(block)[doc]))
                size += len(doc)
                if size >= rule.chunk:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows(found())

    return work


def _steps(pos: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of places within a document, which compress better than the places."""
    out = np.diff(pos, prepend=0)
    out[new] = pos[new]
    return out.astype(np.int32)


def _unsteps(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    begin = np.cumsum(counts) - counts
    return total - np.repeat(total[begin] - steps[begin], counts)


def _degrees(rule: Rule, n: int) -> Callable:
    def work(group: pa.Table) -> pa.Table:
        out = X.passed(group, _NAME)
        parts = []
        for wide, steps, ids, counts in X.each(group, _EDGE):
            key = np.zeros((len(wide), 8), np.uint8)
            key[:, : wide.shape[1]] = wide
            counts = counts.astype(np.int64)
            parts.append((key.reshape(-1).view(np.uint64), _unsteps(steps, counts), np.repeat(ids, counts)))
        if parts:
            key, pos, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
            _, late, lead = _firsts(key, ids, pos, own=True)
            out += _names(n, ids[late], pos[late], ids[lead], pos[lead])
        return X.table(out)

    return work


class _Text:
    """A document's words, one space apart, and where each begins."""

    def __init__(self, data: bytes):
        words = data.split()
        self.data = b" ".join(words)
        self.starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
        self.n = len(words)

    def digest(self, a: int, count: int) -> bytes:
        return blake2b(memoryview(self.data)[self.starts[a] : self.starts[a + count] - 1], digest_size=16).digest()


def _wanted(texts: pa.Table, ids: np.ndarray):
    """(id, tag, words) of the documents with these ids; each row of the same id and text once."""
    seen = set()
    for docs in C.documents(texts):
        for i in np.flatnonzero(np.isin(docs.ids, ids)).tolist():
            key = int(docs.ids[i]), int(docs.tags[i])
            if key not in seen:
                seen.add(key)
                yield *key, _Text(docs.data[docs.offs[i] : docs.offs[i + 1]].tobytes())


def _paths(rule: Rule, n: int) -> Callable:
    """Texts and names in; out: the paths, and one request for each source that some of them have."""

    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        notes = X.blobs(noted, _NAME)
        if not notes:
            return X.table([])
        bucket = noted.column("bucket")[0].as_py()
        ids, pos, src, diff = (np.concatenate(c) for c in zip(*notes, strict=True))
        pos, diff = pos.astype(np.int64), diff.astype(np.int64)
        order = np.lexsort((pos, diff, src, ids))
        ids, pos, src, diff = ids[order], pos[order], src[order], diff[order]
        new = t.runs(ids, src, diff)
        new[1:] |= pos[1:] > pos[:-1] + 1
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(new)) - 1
        ids, src, diff, a, edges = ids[at], src[at], diff[at], pos[at], pos[last] - pos[at] + 1
        cuts, all_ids = np.searchsorted(ids, np.unique(ids)), np.unique(ids)
        cuts = np.append(cuts, len(ids))
        found = []
        for doc, tag, words in _wanted(texts, all_ids):
            k = int(np.searchsorted(all_ids, doc))
            for i in range(cuts[k], cuts[k + 1]):
                first, count = int(a[i]), int(edges[i])
                if first + count - 1 + rule.length <= words.n:
                    found.append((int(src[i]), int(a[i] + diff[i]), count, words.digest(first, count - 1 + rule.length), doc, tag, first))
        asks = sorted({f[:4] for f in found})
        number = {ask: i for i, ask in enumerate(asks)}
        out = [(bucket, _PATH, X.pack([(number[f[:4]], f[0], *f[4:], f[2]) for f in sorted(found)]))]
        made: dict[int, list] = {}
        if asks:
            for to, ask in zip(C.of_id(np.array([x[0] for x in asks], np.int64), n).tolist(), asks, strict=True):
                made.setdefault(to, []).append((*ask, bucket, number[ask]))
        out += [(to, _ASK, X.pack(own)) for to, own in made.items()]
        return X.table(out)

    return work


def _singles(rule: Rule, n: int, words: _Text, doc: int, tag: int, a: int, count: int, made: dict) -> None:
    for i in range(a, a + count):
        digest = words.digest(i, rule.length)
        made.setdefault(int.from_bytes(digest[:8], "little") % n, []).append((digest, doc, tag, i))


def _verify(rule: Rule, n: int) -> Callable:
    """Texts and requests in; out: yes or no for each, and where it is no the source's edges, singly."""

    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        out = X.passed(noted, _PATH)
        asks: dict[int, dict[tuple, list]] = {}
        for blob in X.each(noted, _ASK):
            for src, at, count, digest, bucket, number in blob:
                asks.setdefault(src, {}).setdefault((at, count, digest), []).append((bucket, number))
        yes: dict[int, list] = {}
        no: dict[int, list] = {}
        ones: dict[int, list] = {}
        if asks:
            open_ = {src: set(own) for src, own in asks.items()}
            sources: dict[int, list] = {}
            for doc, tag, words in _wanted(texts, np.array(sorted(asks), np.int64)):
                for ask in list(open_[doc]):
                    at, count, digest = ask
                    if at >= 0 and at + count - 1 + rule.length <= words.n and words.digest(at, count - 1 + rule.length) == digest:
                        open_[doc].discard(ask)
                if open_[doc]:
                    sources.setdefault(doc, []).append((tag, words))
            for src, own in asks.items():
                for ask, askers in own.items():
                    for bucket, number in askers:
                        (no if ask in open_[src] else yes).setdefault(bucket, []).append(number)
                for tag, words in sources.get(src, ()):
                    for at, count, _ in open_[src]:
                        _singles(rule, n, words, src, tag, at, max(0, min(count, words.n - rule.length + 1 - at)), ones)
        for kind, told in ((_YES, yes), (_NO, no), (_ONE, ones)):
            out += [(b, kind, X.pack(own)) for b, own in told.items()]
        return X.table(out)

    return work


def _single(rule: Rule, n: int) -> Callable:
    """Texts and answers in; out: windows that are gone, and the edges of paths whose words aren't their source's."""

    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        out = X.passed(noted, _ONE)
        mine = X.passed(noted, _PATH)
        if not mine:
            return X.table(out)
        bucket, paths = mine[0][0], [p for _, _, blob in mine for p in X.unpack(blob)]
        no = {x for blob in X.each(noted, _NO) for x in blob}
        out.append((bucket, _GONE, X.pack([p[2:] for p in paths if p[0] not in no and p[1] < p[2]])))
        if no:
            ones: dict[int, list] = {}
            left: dict[tuple, list] = {}
            for number, _, doc, tag, a, count in paths:
                if number in no:
                    left.setdefault((doc, tag), []).append((a, count))
            for doc, tag, words in _wanted(texts, np.array(sorted({d for d, _ in left}), np.int64)):
                for a, count in left.get((doc, tag), ()):
                    _singles(rule, n, words, doc, tag, a, count, ones)
            out += [(b, _ONE, X.pack(own)) for b, own in ones.items()]
        return X.table(out)

    return work


def _settle(n: int) -> Callable:
    """Of single edges with the same words, those of a document after the first one are gone."""

    def work(group: pa.Table) -> pa.Table:
        out = X.passed(group, _GONE)
        met: dict[bytes, set] = {}
        for blob in X.each(group, _ONE):
            for digest, *own in blob:
                met.setdefault(digest, set()).add(tuple(own))
        gone: dict[int, list] = {}
        for own in met.values():
            least = min(doc for doc, _, _ in own)
            for doc, tag, a in own:
                if doc > least:
                    gone.setdefault(int(C.of_id(np.array([doc], np.int64), n)[0]), []).append((doc, tag, a, 1))
        return X.table(out + [(b, _GONE, X.pack(x)) for b, x in gone.items()])

    return work


def _finish(rule: Rule) -> Callable:
    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        gone: dict[tuple, list] = {}
        for blob in X.each(noted, _GONE):
            for doc, tag, a, count in blob:
                gone.setdefault((doc, tag), []).append((a, a + count - 1 + rule.length))
        parts = []
        for docs in C.documents(texts):
            words = t.words(docs.data, docs.offs)
            lo, hi = [], []
            for i, key in enumerate(zip(docs.ids.tolist(), docs.tags.tolist(), strict=True)):
                for a, b in gone.get(key, ()):
                    lo.append(a + int(words.offs[i]))
                    hi.append(b + int(words.offs[i]))
            parts.append(C.removed(docs, C.covered(int(words.offs[-1]), np.array(lo, np.int64), np.array(hi, np.int64)), words.offs, True))
        return pa.concat_tables(parts) if parts else C.no_rows()

    return work


def substring_dedup(docs: DataFrame, length: int = 13, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by `length` consecutive words that also start in a document with a smaller id.

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r. Returns one row a row of docs: doc_id,
    n_symbols (words), n_removed, spans (in words, end exclusive), kept (the words that stay, joined by one
    space, as UTF-8 bytes).

    Null text: no words. A null id is larger than any other. Rows that repeat an id don't make one another
    repeats. Texts shorter than `length` stay whole. Other columns are not read. Empty table: no rows.
    """
    rule = rule or Rule(length)
    docs = t.id_text(docs, id_col, text_col)
    n = X.buckets(docs.sparkSession, docs)
    texts = docs.mapInArrow(C.text_rows(n), X.SCHEMA)
    found = X.by_bucket(docs.mapInArrow(_edge_rows(rule, n), X.SCHEMA), _degrees(rule, n))
    found = X.with_bucket(texts, found, _paths(rule, n))
    found = X.with_bucket(texts, found, _verify(rule, n))
    found = X.with_bucket(texts, found, _single(rule, n))
    found = X.by_bucket(found, _settle(n))
    return X.with_bucket(texts, found, _finish(rule), C.OUT)
