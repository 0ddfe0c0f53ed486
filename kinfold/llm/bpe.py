"""BPE encoding and decoding of whole texts, equal to the tokenizers library's.

A vocabulary file's normaliser, split pattern and merges are read from the file.

Tree concatenation: a text longer than a leaf is cut into halves of halves, wherever that is; leaves are encoded on their
own, those of texts longer than `spread` in tasks of their own. Then, from the leaves up, a window around each join
grows until it begins and ends behind a character at which pieces always end, and until what both sides have there agrees with what the
window's halves give; the window is encoded again as one and takes the place of both.

A piece that the split pattern doesn't part is encoded in the same way, with its bytes as symbols: halves of halves on their
own, then a growing window around each join until the token pairs at both of its edges are their own encoding. A sequence of
which every two neighbours are their own encoding is the encoding of the whole (merges are deterministic: the lowest
rank, the leftmost of equals, so a pair that is stable alone is stable in any sequence of such pairs). Pieces of one leaf
of symbols or less are encoded by the library, each distinct one once, and remembered.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t

#: Texts with other characters than these are normalised by the library: nothing below is changed by NFC.
_PLAIN = re.compile("[^\x00-į]")


def _white() -> str:
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


class Merges:
    """Merges of a vocabulary over symbols; works on any stretch of a piece."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.chars = _byte_chars()
        self.pair = lru_cache(1 << 16)(self._pair)

    def symbols(self, piece: str) -> list[str]:
        out = [self.chars[b] for b in piece.encode("utf-8")]
        out[-1] += self.suffix
        return out

    def plain(self, symbols: list[str]) -> list[str]:
        """The encoding by definition: the pair of lowest rank first, the leftmost of equals."""
        out = list(symbols)
        rank, none = self.rank, len(self.rank)
        while len(out) > 1:
            best, at = min((rank.get(p, none), i) for i, p in enumerate(zip(out[:-1], out[1:], strict=True)))
            if best == none:
                break
            out[at : at + 2] = [self.join(out[at], out[at + 1])]
        return out

    def join(self, a: str, b: str) -> str:
        return a + b

    def parts(self, token: str) -> list[str]:
        """A token's symbols."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            own = list(token[: -len(self.suffix)])
            own[-1] += self.suffix
            return own
        return list(token)

    def _pair(self, a: str, b: str) -> bool:
        """Are the two tokens, side by side, their own encoding?"""
        return self.plain([*self.parts(a), *self.parts(b)]) == [a, b]

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of what two encodings cover."""
        if not left or not right or self.pair(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            inner = self.plain([s for x in (*left[a:], *right[:b]) for s in self.parts(x)])
            agrees_left = a == 0 or self.pair(left[a - 1], inner[0])
            agrees_right = b == len(right) or self.pair(inner[-1], right[b])
            if agrees_left and agrees_right:
                return [*left[:a], *inner, *right[b:]]
            size *= 2

    def tree(self, symbols: list[str], leaf: int = 32) -> list[str]:
        level = [self.plain(symbols[i : i + leaf]) for i in range(0, len(symbols), leaf)]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: bytes that print stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


#: A piece ends behind each of these, whatever stands around it: pieces have no white space, and digits are pieces of their own.
_ENDS = re.compile("[ \n\t\r0-9]")


class Encoder:
    """leaf: characters of a text that is encoded at once; symbols: of a piece that is. remembered: pieces kept at once."""

    def __init__(self, path: str, leaf: int = 4096, symbols: int = 32, remembered: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.names = {i: s for s, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.ids = {s: i for i, s in self.names.items()}
        self.ends = np.zeros(max(self.names) + 1, bool)
        if self.suffix:
            self.ends[[i for s, i in model["vocab"].items() if s.endswith(self.suffix)]] = True
        self.merges = Merges(model["vocab"], model["merges"], self.suffix)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        white = _white()
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{re.escape(white)}"), regex.V0).findall
        self.fast = re.compile(_latin(pattern, white)).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.leaf, self.symbols, self.remembered = leaf, symbols, remembered
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.search(text) is None:
            return self.fast(text.lower())
        return self.split(self.library.normalizer.normalize_str(text))

    def _entry(self, tokens: list[str]) -> bytes:
        return np.array([self.ids[x] for x in tokens], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        short = []
        for p in pieces:
            if len(p) * 4 > self.symbols and len(p.encode("utf-8")) > self.symbols:
                self.known[p] = self._entry(self.merges.tree(self.merges.symbols(p), self.symbols))
            else:
                short.append(p)
        if self.suffix:  # one text of all pieces; a token with the suffix ends each
            for i in range(0, len(short), 5000):
                self._learn_text(short[i : i + 5000])
        else:
            self._learn_each(short)

    def _learn_text(self, short: list[str]) -> None:
        ids = np.array(self.library.encode(" ".join(short), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(short):
            return self._learn_each(short)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update(zip(short, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _learn_each(self, short: list[str]) -> None:
        for p, e in zip(short, self.library.encode_batch_fast(short, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, what they decode to)."""
        ids = self.ids_of(text)
        return ids, self.decode(ids)

    def ids_of(self, text: str) -> bytes:
        if len(text) <= self.leaf:
            return self._leaf(text)
        cuts = [*range(0, len(text), self.leaf), len(text)]
        return self.joined(text, cuts, [self._leaf(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def joined(self, text: str, cuts: list[int], parts: list[bytes]) -> bytes:
        """The encoding of a text from those of its parts."""
        while len(parts) > 1:
            level, ends = [], [cuts[0]]
            for i in range(0, len(parts), 2):
                if i + 1 < len(parts):
                    level.append(self._join(text, cuts[i], cuts[i + 1], cuts[i + 2], parts[i], parts[i + 1]))
                    ends.append(cuts[i + 2])
                else:
                    level.append(parts[i])
                    ends.append(cuts[i + 1])
            parts, cuts = level, ends
        return parts[0] if parts else b""

    def _join(self, text: str, begin: int, at: int, end: int, left: bytes, right: bytes) -> bytes:
        size = 32
        while True:
            lo, hi = max(begin, at - size), min(end, at + size)
            before = [m.end() for m in _ENDS.finditer(text, lo, at)]
            after = _ENDS.search(text, at, hi)
            a = before[-1] if before else begin if lo == begin else None
            b = after.end() if after else end if hi == end else None
            if a is not None and b is not None:
                own, other = self._leaf(text[a:at]), self._leaf(text[at:b])
                if left.endswith(own) and right.startswith(other):
                    return left[: len(left) - len(own)] + self._leaf(text[a:b]) + right[len(other) :]
            if lo == begin and hi == end:
                return self._leaf(text[begin:end])
            size *= 2

    def _leaf(self, text: str) -> bytes:
        if self.at_special is not None and "<|" in text and self.at_special.search(text):
            return b"".join([np.array([self.ids[part]], "<u4").tobytes() if i % 2 else self._section(part) for i, part in enumerate(self.at_special.split(text))])
        return self._section(text)

    def _section(self, text: str) -> bytes:
        pieces = self.pieces(text)
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) > self.remembered:
                known.clear()
                new = set(pieces)
            self.learn(new)
        return b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _latin(pattern: str, white: str) -> str:
    """The split pattern for lower-cased text up to U+012F, where letters and numbers can be listed."""
    chars = [chr(c) for c in range(0x130)]
    letters = "".join(c for c in chars if regex.match(r"\p{L}", c))
    numbers = "".join(c for c in chars if regex.match(r"\p{N}", c))
    out = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{re.escape(white + letters + numbers)}]")
    return out.replace("\\p{L}", re.escape(letters)).replace("\\p{N}", re.escape(numbers))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _work(path: str, wanted: tuple[str, ...], leaf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches):
        encoder = Encoder(path, leaf)
        for block in t.blocks(batches):
            data = block.data.tobytes()
            ids = [encoder.ids_of(data[a:b].decode("utf-8", "replace")) for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True)]
            columns = {"doc_id": pa.array(block.ids, mask=block.id_null), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if len(wanted) > 2:
                columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([encoder.decode(x) for x in ids], pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], names=list(wanted))

    return work


def _part_work(path: str, leaf: int) -> Callable:
    def work(batches):
        encoder = Encoder(path, leaf)
        for batch in batches:
            ids = [encoder.ids_of(x) for x in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["key", "place", "part", "ids"])

    return work


def _join_work(path: str, wanted: tuple[str, ...], leaf: int) -> Callable:
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        parts = group.column("part").to_pylist()
        cuts = [0, *np.cumsum([len(p) for p in parts]).tolist()]
        encoder = Encoder(path, leaf)
        ids = encoder.joined("".join(parts), cuts, group.column("ids").to_pylist())
        columns = {"key": group.column("key")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64())}
        if len(wanted) > 2:
            columns |= {"ids": pa.array([ids], pa.binary()), "decoded": pa.array([encoder.decode(ids)], pa.string())}
        return pa.table(columns)

    return work


_TYPES = {"doc_id": "long", "n_tokens": "long", "ids": "binary", "decoded": "string"}


def _encoded(docs: DataFrame, path: str, wanted: tuple[str, ...], spread: int, leaf: int) -> DataFrame:
    """Texts up to `spread` characters where they are; the parts of longer ones are rows, each distinct text once."""
    schema = lambda *first: ", ".join([*first, *(f"{c} {_TYPES[c]}" for c in wanted[1:])])
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > spread
    short = docs.where(~long).mapInArrow(_work(path, wanted, leaf), schema("doc_id long"))
    rows = docs.where(long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    size = F.lit(spread)
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    parts = texts.select("key", "text", F.explode(places).alias("place")).select("key", "place", F.col("text").substr(F.col("place") * size + 1, size).alias("part"))
    parts = parts.repartition("key", "place").mapInArrow(_part_work(path, leaf), "key string, place int, part string, ids binary")
    joined = parts.groupBy("key").applyInArrow(_join_work(path, wanted, leaf), schema("key string"))
    return short.unionByName(rows.select("doc_id", "key").join(joined, "key").select(*wanted))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spread: int = 1 << 20, leaf: int = 4096) -> DataFrame:
    """Encodes, and decodes the ids; one row a row of docs: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    path: a vocabulary file in the tokenizers library's format, with an end-of-word suffix or none, at the same
    place on every executor. spread: bytes from which a text's parts (of as many characters) are encoded by several tasks;
    leaf: characters that are encoded at once. Null or empty text: no ids, an empty decoded text. A null id stays null;
    repeated rows are told as often; a text of any length is encoded whole. Other columns are not read. Empty table: no rows.
    """
    return _encoded(t.id_text(docs, id_col, text_col), path or default_vocabulary(), ("doc_id", "n_tokens", "ids", "decoded"), spread, leaf)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spread: int = 1 << 20, leaf: int = 4096) -> DataFrame:
    """doc_id and n_tokens of each row; null or empty text: 0."""
    return _encoded(t.id_text(docs, id_col, text_col), path or default_vocabulary(), ("doc_id", "n_tokens"), spread, leaf)
