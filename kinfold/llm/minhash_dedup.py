"""MinHash near-dedup by a multi-index Hamming join, with every link confirmed on the whole sets.

1. `signatures`: of each text the set of its distinct word shingles, 64 minima of hash functions, 16 bits each,
   and a 128-bit fingerprint of the set; texts with the same set are one class.
2. `pairs`: a signature is split into 16 chunks of 4 values. Two signatures that differ in at most 31 of 64 values
   have a chunk that differs in at most one (pigeonhole), so each chunk with each one value left out is a key:
   64 keys, and no pair within the distance is missed. At a similarity of 0.8 a value differs with a
   probability below 0.2, so that more than 31 differ for less than one in ten million pairs.
   Those who share a key are not paired with each other but with the key's smallest id, first within a task,
   then over all tasks.
3. `confirm`: pairs meet the two whole sets.
4. Components of confirmed links. Those that share a key but ended up in different components were perhaps never
   compared: `missed` pairs them, once each, where their signatures are within the distance, and these pairs are
   confirmed in turn. The members of a key are split into blocks, of which each two meet in a bucket of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus as C
from . import exchange as X
from . import text as t
from .components import components

_KEY, _PAIR, _NEED, _SET, _OWN = 10, 11, 12, 13, 14


@dataclass(frozen=True)
class Rule:
    """words of a shingle; percent: least similarity; values: of a signature; chunk: values of a chunk;
    block: members of a key that are compared with one another at once; more are split into blocks, of which each two meet somewhere."""

    words: int = 5
    percent: int = 80
    values: int = 64
    chunk: int = 4
    block: int = 512

    @property
    def distance(self) -> int:
        """Values that may differ so that a chunk differs in one at most."""
        return 2 * (self.values // self.chunk) - 1


def _sets(block: t.Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingles end to end, and where each text's begin."""
    data = t.LOWER[block.data]
    found = t.words(data, block.offs)
    values = t.word_values(data, found)
    many = t.Rolling(values).every(words)
    cuts = found.offs.tolist()
    parts, sizes = [], [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= words:
            own = np.sort(many[a : b - words + 1])
            own = own[t.runs(own)]
        elif b > a:
            own = t.mix(t.Rolling(values[a:b]).every(b - a) + np.uint64(b - a))
        else:
            own = many[:0]
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else many[:0]), np.cumsum(sizes)


def _factors(n: int) -> np.ndarray:
    return t.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _signatures(rule: Rule) -> Callable:
    factors = _factors(rule.values)

    def work(batches):
        for block in t.blocks(batches, t.BLOCK_BYTES // 2):
            sets, offs = _sets(block, rule.words)
            n = np.diff(offs)
            some = np.flatnonzero(n)
            sig = np.zeros((len(n), rule.values), np.uint16)
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                begin = offs[:-1][some]
                one[some], two[some] = np.add.reduceat(t.mix(sets), begin), np.add.reduceat(t.mix(~sets), begin)
                for k, f in enumerate(factors):
                    low = t.mix(np.minimum.reduceat(sets * f, begin))
                    sig[some, k] = (low >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, mask=block.id_null), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n_shingles", "one", "two", "sig"],
            )

    return work


def _keys(sig: np.ndarray, rule: Rule) -> Iterator[np.ndarray]:
    """Every chunk with every one value left out."""
    chunks = sig.reshape(len(sig), -1, rule.chunk).astype(np.uint64)
    for c in range(chunks.shape[1]):
        for out in range(rule.chunk):
            key = np.full(len(sig), 1 + c * rule.chunk + out, np.uint64)
            for k in range(rule.chunk):
                if k != out:
                    key = t.mix(key * np.uint64(0x9E3779B97F4A7C15) + chunks[:, c, k])
            yield key


def _hubs(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the least id of each key; of the others, their ids and the least ids."""
    order = np.lexsort((ids, key))
    new = t.runs(key[order])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    own, hub = ids[order], ids[order][lead]
    other = own != hub
    return order[new], own[other], hub[other]


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (t.mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _of_key(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def _pairs(n: int, own: np.ndarray, hub: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    if len(own):
        pairs = np.unique(np.stack([own, hub], 1), axis=0)
        for b, cols in X.split(_bucket(pairs[:, 0].copy(), n), pairs[:, 0], pairs[:, 1]):
            yield b, _PAIR, X.pack(cols)


def _sigs(batch: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(ids), rule.values)


def _key_rows(rule: Rule, n: int, chunk: int = 20_000) -> Callable:
    def work(batches):
        def found():
            held, size = [], 0

            def flush():
                ids, sig = (np.concatenate(c) for c in zip(*held, strict=True))
                own, hub = [], []
                made: dict[int, list] = {}
                for key in _keys(sig, rule):
                    at, a, b = _hubs(key, ids)
                    own.append(a)
                    hub.append(b)
                    for bucket, cols in X.split(_of_key(key[at], n), key[at], ids[at]):
                        made.setdefault(bucket, []).append(cols)
                yield from _pairs(n, np.concatenate(own), np.concatenate(hub))
                for bucket, cols in made.items():
                    yield bucket, _KEY, X.pack(tuple(np.concatenate(c) for c in zip(*cols, strict=True)))

            for batch in batches:
                if batch.num_rows:
                    held.append(_sigs(batch, rule))
                    size += batch.num_rows
                if size >= chunk:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows(found())

    return work


def _meet(n: int) -> Callable:
    """A bucket's keys to pairs with each key's least id; pairs pass, once each."""

    def work(group: pa.Table) -> pa.Table:
        out = X.passed(group, _PAIR)
        keys = X.blobs(group, _KEY)
        if keys:
            _, own, hub = _hubs(*(np.concatenate(c) for c in zip(*keys, strict=True)))
            out += _pairs(n, own, hub)
        return X.table(out)

    return work


def _needs(n: int) -> Callable:
    """Pairs (by the bucket of the first), once each; and for each bucket whose sets are needed there."""

    def work(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        own, hub = X.columns(X.blobs(group, _PAIR), [np.int64, np.int64])
        pairs = np.unique(np.stack([own, hub], 1), axis=0)
        out = [(bucket, _PAIR, X.pack((pairs[:, 0].copy(), pairs[:, 1].copy())))]
        ids = np.unique(pairs)
        for b, (at,) in X.split(_bucket(ids, n), ids):
            out.append((b, _NEED, X.pack((at, np.full(len(at), bucket, np.int32)))))
        return X.table(out)

    return work


def _text_rows(n: int, limit: int = 16 << 20) -> Callable:
    def work(batches):
        def found():
            held, size = [], 0

            def flush():
                ids, lens = (np.concatenate(c) for c in zip(*(x[:2] for x in held), strict=True))
                data = np.concatenate([x[2] for x in held])
                offs = np.concatenate([[0], np.cumsum(lens)])
                for b, (at,) in X.split(_bucket(ids, n), np.arange(len(ids))):
                    yield b, _SET, X.pack((ids[at], lens[at], np.concatenate([data[offs[i] : offs[i + 1]] for i in at.tolist()])))

            for block in t.blocks(batches):
                some = ~block.id_null
                if not some.all():
                    block = _only(block, some)
                held.append((block.ids, np.diff(block.offs), block.data.copy()))
                size += len(block.data)
                if size >= limit:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows(found(), 1)

    return work


def _only(block: t.Block, some: np.ndarray) -> t.Block:
    at = np.flatnonzero(some)
    parts = [block.data[block.offs[i] : block.offs[i + 1]] for i in at.tolist()]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return t.Block(block.ids[at], block.id_null[at], block.null[at], np.concatenate(parts) if parts else block.data[:0], offs)


def _send(rule: Rule, n: int) -> Callable:
    """Texts and needs in; the sets go where they are needed, pairs pass."""

    def work(texts: pa.Table, noted: pa.Table) -> pa.Table:
        out = X.passed(noted, _PAIR)
        ids, to = X.columns(X.blobs(noted, _NEED), [np.int64, np.int32])
        if not len(ids):
            return X.table(out)
        order = np.lexsort((to, ids))
        ids, to = ids[order], to[order]
        made: dict[int, list] = {}
        for own, lens, data in X.blobs(texts, _SET):
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            some = np.isin(own, ids)
            if not some.any():
                continue
            null = np.zeros(len(own), bool)
            block = _only(t.Block(own, null, null, data, offs), some)
            i, total = 0, len(block.ids)
            while i < total:
                j = min(total, max(i + 1, int(np.searchsorted(block.offs, block.offs[i] + t.BLOCK_BYTES, "right")) - 1))
                part = t.Block(block.ids[i:j], null[i:j], null[i:j], block.data[block.offs[i] : block.offs[j]], block.offs[i : j + 1] - block.offs[i])
                sets, cuts = _sets(part, rule.words)
                for k, doc in enumerate(part.ids.tolist()):
                    for bucket in to[np.searchsorted(ids, doc) : np.searchsorted(ids, doc, "right")].tolist():
                        made.setdefault(bucket, []).append((doc, sets[cuts[k] : cuts[k + 1]]))
                i = j
        for bucket, found in made.items():
            out.append((bucket, _SET, X.pack((np.array([d for d, _ in found], np.int64), np.array([len(s) for _, s in found]), np.concatenate([s for _, s in found])))))
        return X.table(out)

    return work


LINKS = "a long, b long, shared long, total long"


def _confirm(rule: Rule) -> Callable:
    def work(group: pa.Table) -> pa.Table:
        own, hub = X.columns(X.blobs(group, _PAIR), [np.int64, np.int64])
        sets: dict[int, np.ndarray] = {}
        for ids, lens, data in X.blobs(group, _SET):
            offs = np.cumsum(lens)
            sets.update(zip(ids.tolist(), np.split(data, offs[:-1]), strict=True))
        rows = []
        none = np.zeros(0, np.uint64)
        for a, b in np.unique(np.stack([own, hub], 1), axis=0).tolist():
            x, y = sets.get(a, none), sets.get(b, none)
            if len(x) and len(y) and 100 * min(len(x), len(y)) >= rule.percent * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                total = len(x) + len(y) - shared
                if 100 * shared >= rule.percent * total:
                    rows.append((a, b, shared, total))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "total"])

    return work


def _confirmed(docs: DataFrame, pairs: DataFrame, rule: Rule, n: int) -> DataFrame:
    needs = X.by_bucket(pairs, _needs(n))
    sent = X.with_bucket(docs.mapInArrow(_text_rows(n), X.SCHEMA), needs, _send(rule, n))
    return X.by_bucket(sent, _confirm(rule), LINKS)


def _pair_ids(batches):
    for batch in batches:
        for pairs in X.each(pa.Table.from_batches([batch]), _PAIR):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(pairs)))], names=["doc_id"])


def _parts(batch: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sig = _sigs(batch, rule)
    return ids, batch.column("component").to_numpy(zero_copy_only=False).astype(np.int64), sig


def _own_rows(rule: Rule, n: int) -> Callable:
    """(doc_id, component, sig) by the bucket of the ids."""

    def work(batches):
        yield from X.rows((b, _OWN, X.pack(cols)) for batch in batches if batch.num_rows for ids, part, sig in [_parts(batch, rule)] for b, cols in X.split(_bucket(ids, n), ids, part, sig))

    return work


def _member_rows(rule: Rule, n: int) -> Callable:
    """(doc_id, component, sig) to (key, component, id)."""

    def work(batches):
        def found():
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, part, sig = _parts(batch, rule)
                made: dict[int, list] = {}
                for key in _keys(sig, rule):
                    for bucket, cols in X.split(_of_key(key, n), key, part, ids):
                        made.setdefault(bucket, []).append(cols)
                for bucket, cols in made.items():
                    yield bucket, _KEY, X.pack(tuple(np.concatenate(c) for c in zip(*cols, strict=True)))

        yield from X.rows(found())

    return work


def _mixed(rule: Rule, n: int) -> Callable:
    """Of keys that several components have, each member's (id, key, number of blocks) to the bucket of the id."""

    def work(group: pa.Table) -> pa.Table:
        key, part, ids = (np.concatenate(c) for c in zip(*X.blobs(group, _KEY), strict=True))
        order = np.lexsort((part, key))
        key, part, ids = key[order], part[order], ids[order]
        which = np.cumsum(t.runs(key)) - 1
        many = (np.bincount(which[t.runs(key, part)]) > 1)[which]
        blocks = (-(-np.bincount(which) // rule.block)).astype(np.int32)[which]
        return X.table((b, _NEED, X.pack(cols)) for b, cols in X.split(_bucket(ids[many], n), ids[many], key[many], blocks[many]))

    return work


def _with_signatures(rule: Rule, n: int) -> Callable:
    """Members with their signatures to all pairs of blocks that their own is in. one, two: the blocks of a pair; own: is it the first?"""

    def work(own: pa.Table, noted: pa.Table) -> pa.Table:
        wanted, key, blocks = X.columns(X.blobs(noted, _NEED), [np.int64, np.uint64, np.int32])
        if not len(wanted):
            return X.table([])
        ids, part, sig = (np.concatenate(c) for c in zip(*X.blobs(own, _OWN), strict=True))
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], wanted)]
        mine = (t.mix(wanted.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
        row, other = C.pick(np.zeros(len(wanted), np.int64), blocks.astype(np.int64))
        one, two = np.minimum(mine[row], other).astype(np.int32), np.maximum(mine[row], other).astype(np.int32)
        to = _of_key(t.mix(key[row] + (one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64))), n)
        # A block's members travel once for each other block, so signatures are looked up only as rows are packed
        return X.table((b, _SET, X.pack((key[r], o, w, mine[r], part[at[r]], wanted[r], sig[at[r]]))) for b, (r, o, w) in X.split(to, row, one, two))

    return work


def _first_key(equal: np.ndarray, chunk: int) -> np.ndarray:
    """The place of the first key that rows of equal values share, as `_keys` counts them; -1 if none."""
    off = ~equal.reshape(len(equal), equal.shape[1] // chunk, chunk)
    few = off.sum(2) <= 1
    c = few.argmax(1)
    own = off[np.arange(len(off)), c]
    return np.where(few.any(1), c * chunk + own.argmax(1), -1)


def _cross(rule: Rule, side: int = 256) -> Callable:
    """Pairs of members from different components, within the distance, of two blocks of a key; each pair at the first key it shares."""

    def work(group: pa.Table) -> pa.Table:
        key, one, two, mine, part, ids, sig = (np.concatenate(c) for c in zip(*X.blobs(group, _SET), strict=True))
        order = np.lexsort((ids, mine, two, one, key))
        key, one, two, mine, part, ids, sig = (c[order] for c in (key, one, two, mine, part, ids, sig))
        cuts = [*np.flatnonzero(t.runs(key, one, two)).tolist(), len(key)]
        made: list[np.ndarray] = []
        places = np.zeros(len(cuts) - 1, np.int64)
        for k, own in enumerate(_keys(sig[cuts[:-1]], rule)):
            places[own == key[cuts[:-1]]] = k
        for a, b, place in zip(cuts[:-1], cuts[1:], places.tolist(), strict=True):
            middle = a + int(np.searchsorted(mine[a:b], one[a], "right"))
            pairs = [(i, j, b, b) for i in range(a, b, side) for j in range(i, b, side)] if one[a] == two[a] else [(i, j, middle, b) for i in range(a, middle, side) for j in range(middle, b, side)]
            for i, j, last, end in pairs:
                x, y = slice(i, min(i + side, last)), slice(j, min(j + side, end))
                equal = sig[x][:, None] == sig[y][None]
                far = rule.values - equal.sum(2) > rule.distance
                p, q = np.nonzero(~far & (part[x][:, None] != part[y][None]))
                own = _first_key(equal[p, q], rule.chunk) == place
                first, second = ids[x][p[own]], ids[y][q[own]]
                low, high = np.minimum(first, second), np.maximum(first, second)
                made.append(np.stack([high, low], 1))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *made]), axis=0)
        bucket = group.column("bucket")[0].as_py()  # what meets here is confirmed here: a member's set is sent once for each other block
        return X.table([(bucket, _PAIR, X.pack((pairs[:, 0].copy(), pairs[:, 1].copy())))] if len(pairs) else [])

    return work


def _missed(sigs: DataFrame, pairs: DataFrame, parts: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Packed pairs of the same key and different components, no further apart than signatures may be."""
    some = pairs.mapInArrow(_pair_ids, "doc_id long").distinct()
    own = sigs.join(some, "doc_id", "left_semi").join(parts, sigs.doc_id == parts.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "sig")
    own = X.kept(own)
    mixed = X.by_bucket(own.mapInArrow(_member_rows(rule, n), X.SCHEMA), _mixed(rule, n))
    full = X.with_bucket(own.mapInArrow(_own_rows(rule, n), X.SCHEMA), mixed, _with_signatures(rule, n))
    return X.kept(X.by_bucket(full, _cross(rule)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """Links documents whose shingle sets have 100 * |intersection| >= percent * |union|; one row a row of docs.

    Returns doc_id, n_shingles, component_id (the smallest id reachable over links, itself included), kept
    (doc_id = component_id). Words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r, with A-Z lower-cased; a
    text with fewer than `words` words has its whole sequence as one shingle; one without words has none and is
    linked with nothing. Shingles are told apart by 64 bits. block: of `Rule`.

    Null text: no words. Null id: linked with nothing, component_id null, kept. Rows that repeat an id and a
    text are one document, given as often; rows that repeat an id with other texts share their component. Other
    columns are not read. Empty table: no rows.
    """
    rule = Rule(words, percent, block=block)
    n = X.buckets(docs.sparkSession, docs)
    docs = t.id_text(docs, id_col, text_col)
    made = X.kept(docs.mapInArrow(_signatures(rule), "doc_id long, n_shingles long, one long, two long, sig binary"))
    some = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    reps = X.kept(reps)
    sigs = reps.select(F.col("rep").alias("doc_id"), "sig")
    pairs = X.kept(X.by_bucket(sigs.mapInArrow(_key_rows(rule, n), X.SCHEMA), _meet(n)))
    links = X.kept(_confirmed(docs, pairs, rule, n))
    parts = X.kept(components(links))
    missed = _missed(sigs, pairs, parts, rule, n)
    if not missed.isEmpty():
        links = links.union(_confirmed(docs, missed, rule, n))
        parts = X.kept(components(links))
    named = reps.join(parts, reps.rep == parts.node, "left").select("one", "two", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two", "n_shingles"], "left")
    part = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", part.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
