"""Language ID: interpolated Kneser-Ney models over characters, one for each language.

A model's n-grams are 64-bit hashes in sorted arrays, one array for each order, shared by the languages: next to a
hash stand each language's log-probability (if the n-gram was seen for it, with the lower orders already
interpolated) and, for contexts, its back-off weight. A text goes to the language with the lowest cross-entropy per
character; one whose cross-entropy is above what all but a share REJECT of the language's own stretches of that length
reach, in texts that the model hasn't learned from, is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t
from .sampling import texts_of

ORDER = 4
#: Share of a language's own stretches of text that may be above its limit.
REJECT = 0.001
#: Nats per character above that, as the stretches are of a bounded sample: these, and so many by the root of its number of texts.
MARGIN = 0.25, 1.5
#: Nats that a letter costs further which no language's texts had: it is one of many such.
UNSEEN = 4.0
#: Symbols of the stretches that limits are set for; longer texts have the last one's.
_SIZES = tuple(1 << k for k in range(3, 12))
_DISCOUNT = 0.75
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters' code points; each stretch of others is one space; one space at both ends. Empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.full(len(codes) + 2, 32, np.uint64)
    out[1:-1] = np.where(letter, codes, 32)
    stay = np.ones(len(out), bool)
    stay[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[stay]


def _grams(s: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all stretches of `order` symbols."""
    n = len(s) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ s[k : k + n]) * _P
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Models:
    """hashes[i], probs[i]: of order i + 1; contexts[i], weights[i]: of contexts of i + 1 symbols; limit: by size and language."""

    langs: list[str]
    hashes: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    limit: np.ndarray
    heat: float

    def position_scores(self, s: np.ndarray) -> np.ndarray:
        """Log-probability of every symbol from the second on, by language. Symbols before the first are not known."""
        n = len(s) - 1
        out = np.zeros((max(n, 0), len(self.langs)), np.float32)
        rest = np.arange(n)
        for order in range(ORDER, 0, -1):
            usable = rest + 2 >= order  # symbols up to and including this one
            at = rest[usable]
            if not len(at):
                continue
            grams = _grams(s, order)[at + 2 - order]
            found, row = _find(self.hashes[order - 1], grams)
            out[at[found]] += self.probs[order - 1][row[found]]
            missed = at[~found]
            if order > 1 and len(missed):
                seen, row = _find(self.contexts[order - 2], _grams(s, order - 1)[missed + 2 - order])
                out[missed[seen]] += self.weights[order - 2][row[seen]]
            rest = np.concatenate([rest[~usable], missed])
        out[rest] += np.float32(self.floor - UNSEEN)
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text, nats per symbol in each language; nan for texts without symbols."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        some = [i for i, s in enumerate(texts) if len(s)]
        if some:
            # Texts begin and end with a space; the last of one serves the next as its first.
            joined = np.concatenate([np.array([32], np.uint64), *(texts[i][1:] for i in some)])
            scores = self.position_scores(joined)
            sizes = np.array([len(texts[i]) - 1 for i in some])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for k in range(len(self.langs)):
                out[some, k] = -np.add.reduceat(scores[:, k].astype(np.float64), begin) / sizes
        return out

    def judge(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's place or -1, score, rejected) of rows of entropies and the texts' numbers of symbols."""
        none = np.isnan(entropy[:, 0])
        safe = np.where(none[:, None], 0.0, entropy)
        best = safe.argmin(1)
        least = safe[np.arange(len(best)), best]
        score = 1.0 / np.exp((least[:, None] - safe) * self.heat).sum(1)
        rejected = none | (least > self.limit[_size_class(sizes), best])
        return np.where(none, -1, best), np.where(none, 0.0, score), rejected


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    row = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[row] == wanted, row


def _counts(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, ...]:
    """Distinct stretches: hash, hash without the first symbol, without the last, count."""
    full = np.concatenate([np.zeros(0, np.uint64), *(_grams(s, order) for s in texts)])
    if order == 1:
        tail = head = np.zeros(len(full), np.uint64)
    else:
        tail = np.concatenate([np.zeros(0, np.uint64), *(_grams(s, order - 1)[1:] for s in texts if len(s) >= order)])
        head = np.concatenate([np.zeros(0, np.uint64), *(_grams(s, order - 1)[:-1] for s in texts if len(s) >= order)])
    hashes, at, counts = np.unique(full, return_index=True, return_counts=True)
    return hashes, tail[at], head[at], counts.astype(np.float64)


def train(samples: dict[str, list[str]], held: int = 5) -> Models:
    """samples: texts by language. Every held-th text of a language only calibrates, where there are as many."""
    langs = sorted(samples)
    fits, checks = {}, {}
    for lang in langs:
        own = [s for s in map(symbols, samples[lang]) if len(s)]
        checks[lang] = own[::held] if len(own) >= 2 * held else own
        fits[lang] = [s for i, s in enumerate(own) if i % held] if len(own) >= 2 * held else own
    alphabet = len(np.unique(np.concatenate([np.array([32], np.uint64), *(s for own in fits.values() for s in own)]))) + 1
    floor = -math.log(alphabet)
    tables = {lang: [_counts(fits[lang], k) for k in range(1, ORDER + 1)] for lang in langs}
    models = Models(langs, [], [], [], [], floor, np.full((len(_SIZES), len(langs)), -floor), 1.0)
    for order in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(tables[x][order - 1][0] for x in langs)]))
        parents = np.unique(np.concatenate([np.zeros(0, np.uint64), *(tables[x][order - 1][2] for x in langs)])) if order > 1 else np.zeros(1, np.uint64)
        probs, weights = np.zeros((len(grams), len(langs))), np.zeros((len(parents), len(langs)))
        tails, heads = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for hashes, tail, head, _ in (tables[x][order - 1] for x in langs):
            at = np.searchsorted(grams, hashes)
            tails[at], heads[at] = tail, head
        lower = np.full((len(grams), len(langs)), math.exp(floor))
        if order > 1 and len(grams):
            found, row = _find(models.hashes[-1], tails)
            lower = np.where(found[:, None], np.exp(models.probs[-1][row]), lower)
        own = np.searchsorted(parents, heads)
        for k, lang in enumerate(langs):
            hashes, _, _, counts = tables[lang][order - 1]
            if order < ORDER and len(hashes):  # the lower orders count in how many contexts a stretch occurs
                longer = tables[lang][order]
                counts = np.bincount(np.searchsorted(hashes, longer[1]), minlength=len(hashes)).astype(np.float64)
            full = np.zeros(len(grams))
            full[np.searchsorted(grams, hashes)] = counts
            total = np.bincount(own, full, len(parents))
            kinds = np.bincount(own, full > 0, len(parents))
            rest = np.where(total > 0, _DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            weights[:, k] = np.log(rest)
            probs[:, k] = np.log(np.maximum(full - _DISCOUNT, 0) / np.maximum(total, 1e-9)[own] + rest[own] * lower[:, k])
        models.hashes.append(grams)
        models.probs.append(probs.astype(np.float32))
        if order > 1:
            models.contexts.append(parents)
            models.weights.append(weights.astype(np.float32))
    _calibrate(models, checks)
    return models


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(np.array(_SIZES), sizes, "right") - 1, 0)


def _stretches(texts: list[np.ndarray], each: int = 12) -> list[np.ndarray]:
    """The texts, and of each up to `each` stretches of every size, evenly spread."""
    out = list(texts)
    for s in texts:
        for size in _SIZES:
            if len(s) > size:
                out += [s[a : a + size] for a in np.unique(np.linspace(0, len(s) - size, each).astype(int)).tolist()]
    return out


def _calibrate(models: Models, checks: dict[str, list[np.ndarray]]) -> None:
    """limit: what all but REJECT of a language's own stretches of a size reach, and no less than for a larger size; heat: the most likely one."""
    entropy, truth, sizes = [], [], []
    for k, lang in enumerate(models.langs):
        own = _stretches(checks[lang])
        if not own:
            continue
        e, n = models.entropies(own), np.array([len(s) for s in own])
        kind = _size_class(n)
        margin = MARGIN[0] + MARGIN[1] / math.sqrt(len(checks[lang]))
        highest = -np.inf
        for c in range(len(_SIZES) - 1, -1, -1):
            if (kind == c).any():
                highest = max(highest, float(np.quantile(e[kind == c, k], 1 - REJECT)) + margin)
            models.limit[c, k] = highest if np.isfinite(highest) else -models.floor
        entropy.append(e)
        truth += [k] * len(own)
        sizes.append(n)
    if truth:
        e, y = np.concatenate(entropy), np.array(truth)
        loss = {}
        for step in range(40):
            heat = 1.25**step
            loss[heat] = float(np.mean(np.log(np.exp(np.minimum((e[np.arange(len(y)), y][:, None] - e) * heat, 500)).sum(1))))
        models.heat = min(loss, key=loss.get)


OUT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _work(models: Models) -> Callable:
    def work(batches):
        for block in t.blocks(batches, t.BLOCK_BYTES // 2):
            data = block.data.tobytes()
            texts = [symbols(data[a:b].decode("utf-8", "replace")) for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True)]
            if models.langs:
                entropy = models.entropies(texts)
                best, score, rejected = models.judge(entropy, np.array([len(s) for s in texts]))
                least = np.where(best < 0, np.nan, entropy[np.arange(len(best)), best])
            else:
                best, score, least = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan)
                rejected = np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, mask=block.id_null), pa.array([models.langs[i] if i >= 0 else "und" for i in best.tolist()], pa.string()), pa.array(score), pa.array(least, mask=np.isnan(least)), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return work


def learned(docs: DataFrame, learn: Column | None = None, rows: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of up to `rows` texts of each language."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    samples: dict[str, list[str]] = {}
    for lang, _, text in texts_of(own, rows, learn, "lang"):
        samples.setdefault(lang, []).append(text)
    return train(samples)


def judged(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected beside each row."""
    return t.beside(docs, _work(models), OUT, id_col, text_col, prefix)


def identify(docs: DataFrame, learn: Column | None = None, rows: int = 300, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a row of docs: doc_id, lang_pred, score (0 to 1), cross_entropy (nats per character), rejected.

    learn: which rows may be learned from (default all); rows: how many of each language are, at most, of those with
    text and a language. Predictions use the text alone, all of it. lang_pred is a learned language, or und if the text
    is null or has no letter or nothing could be learned; then score is 0, cross_entropy null and rejected true.
    Ties go to the first language by name. Null ids stay null; repeated rows are judged as often; other columns are
    not read. Empty table: no rows.
    """
    if models is None:
        models = learned(docs, learn, rows, id_col, text_col, lang_col)
    return t.id_text(docs, id_col, text_col).mapInArrow(_work(models), OUT)
