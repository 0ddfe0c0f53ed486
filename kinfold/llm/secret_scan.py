"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are chains over character pairs, fitted on labelled samples: random strings are the values that the
fixed patterns find in a bounded sample of texts, with seeded draws from the usual alphabets; ordinary
identifiers are the sample's other tokens but those that the models are to judge, and compounds of the sample's words and of
usual words of code, in the usual ways of writing them. Every third label of either kind only sets the thresholds.

Every token from SHORT characters is judged by the mean log-likelihood ratio of its pairs. With letters and digits
it is a secret above a threshold that 99 in 100 ordinary tokens with digits don't pass, or, below LEAST characters, one for each
length that 98 in 100 random strings pass; without digits, above what any ordinary token without digits has reached.
Where a token doesn't pass as a whole, its parts between / and = are judged. UUIDs are identifiers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as t
from .sampling import texts_of

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_INSIDE = t.lut(TOKEN_CHARS + ".")
_DIGIT = t.lut("0123456789")
_HINTS = ("passw", "secret", "token", "api")
LEAST, SHORT = 20, 12
#: No threshold is lower.
FLOOR = 0.5
_PART = re.compile(r"[^/=]+")


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of what the fixed patterns find."""
    out = []
    low = text.lower() if low is None else low
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _chain(tokens: Iterable[str]) -> np.ndarray:
    """Log-probabilities of each next character; the last row is of first characters."""
    n = len(TOKEN_CHARS)
    place = {c: i for i, c in enumerate(TOKEN_CHARS)}
    counts = np.full((n + 1, n), 0.2)
    for token in tokens:
        before = n
        for c in folded(token):
            now = place.get(c)
            if now is None:
                before = n
                continue
            counts[before, now] += 1
            before = now
    return np.log(counts / counts.sum(1, keepdims=True))


def candidate(token: str) -> bool:
    """Long, with letters and digits: what the models judge, and so no label by itself."""
    return len(token) >= LEAST and _mixed(token)


def folded(token: str) -> str:
    """A token without small letters is judged as if its capitals were small: CONSTANT_CASE is no sign of chance."""
    return token.lower() if token.upper() == token else token


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


#: Lengths that have a threshold of their own; longer tokens have the last one's.
_LENGTHS = 64


@dataclass(frozen=True)
class Model:
    """ratio: log-likelihood ratio of each pair, and of first characters in the last row; limits: of a token's mean, by kind (without digits, with digits and letters, digits alone) and length."""

    ratio: np.ndarray
    limits: np.ndarray

    def score(self, token: str) -> float:
        token = folded(token)
        at = _PLACES[np.frombuffer(token.encode("latin-1"), np.uint8)]
        return float((self.ratio[at[:-1], at[1:]].sum() + self.ratio[-1, at[0]]) / len(at))

    def random(self, token: str) -> bool:
        if len(token) < SHORT or UUID.fullmatch(token):
            return False
        kind = sum(any(f(c) for c in token) * w for f, w in ((str.isdigit, 1), (str.isalpha, 2)))
        return self.score(token) > self.limits[kind, min(len(token), _LENGTHS)]

    def random_spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in _TOKEN.finditer(text):
            if m.end() - m.start() < SHORT:
                continue
            if self.random(m.group()):
                out.append(m.span())
            elif not UUID.fullmatch(m.group()):
                out += [p.span() for p in _PART.finditer(text, *m.span()) if SHORT <= p.end() - p.start() < m.end() - m.start() and self.random(p.group())]
        return out

    def suspects(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts may have a random token: the same judgement of all tokens at once, but for rounding."""
        out = np.zeros(len(offs) - 1, bool)
        places = [_PLACES[data], _PLACES[t.LOWER[data]]]
        pairs = [np.zeros(len(data) + 1) for _ in places]
        if len(data):
            for p, own in zip(pairs, places, strict=True):
                p[2:] = np.cumsum(self.ratio[own[:-1], own[1:]])
        small = np.concatenate([[0], np.cumsum(_SMALL[data], dtype=np.int32)])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
        letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
        for inside in (_IN_TOKEN, _IN_PART):
            found = t.words(data, offs, inside)
            size = found.ends - found.starts
            long = np.flatnonzero(size >= SHORT)
            a, b, n = found.starts[long], found.ends[long], size[long]
            score = np.where(small[b] > small[a], *((p[b] - p[a + 1] + self.ratio[-1, own[a]]) / n for p, own in zip(pairs, places, strict=True)))
            kind = (digits[b] > digits[a]) + 2 * (letters[b] > letters[a])
            hit = long[score > self.limits[kind, np.minimum(n, _LENGTHS)] - 1e-6]
            out[np.searchsorted(found.offs, hit, "right") - 1] = True
        return out


_PLACES = np.zeros(256, np.int64)
_PLACES[np.frombuffer(TOKEN_CHARS.encode(), np.uint8)] = np.arange(len(TOKEN_CHARS))
_IN_TOKEN, _IN_PART = t.lut(TOKEN_CHARS), t.lut(TOKEN_CHARS.replace("/", "").replace("=", ""))
_LETTER, _SMALL = t.lut(TOKEN_CHARS[:52]), t.lut(TOKEN_CHARS[26:52])
UUID = re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")

# Fixed values.
#: Ordinary identifiers that a sample of prose may lack.
IDENTIFIERS = (
    "user_id2 order_line_item_3 get_value_by_index0 http_response_code_200 max_retry_count_10 parse_json_file_v2 "
    "section-1-introduction chapter-12-results image_2024_final version_1_2_3_release total_amount_2023_q4 "
    "test_case_number_15 customer_address_line2 internationalization_i18n department_of_statistics_2021"
).split()
#: Words that identifiers are made of.
WORDS = (
    "get set add remove update delete create read write load save open close start stop run test check find search sort filter map reduce count sum total "
    "user account email address name first last phone order line item product price amount quantity date time year month day hour minute second "
    "file path folder directory image video audio text string number integer value key index list array table row column field record data base "
    "content security policy level type status code error message response request header body http https json xml html css server client "
    "service manager handler controller factory builder provider context session token cache queue stack node edge graph tree parent child "
    "section chapter introduction result summary report version release final draft public private static default config option parameter "
    "how to train your model in steps the best of guide for beginners with and by from on customer department statistics international"
).split()


def compounds(words: list[str], count: int, seed: int) -> list[str]:
    """Words put together as identifiers are: camelCase, PascalCase, snake_case, kebab-case, CONSTANT_CASE, paths, with numbers and years."""
    rnd, out = random.Random(seed), []
    for i in range(count):
        own = [rnd.choice(words) for _ in range(rnd.randint(2, 6))]
        if rnd.random() < 0.4:
            own.insert(rnd.randint(1, len(own)), rnd.choice((str(rnd.randint(0, 9)), str(rnd.randint(10, 99)), str(rnd.randint(1990, 2035)), f"v{rnd.randint(1, 9)}", "2024-01-15", "20240115", "10-05")))
        how = i % 6
        if how < 2:
            out.append("".join(w if how == 0 and k == 0 else w[:1].upper() + w[1:] for k, w in enumerate(own)))
        else:
            out.append(("_", "-", "_", "/")[how - 2].join(w.upper() if how == 4 else w for w in own))
    return out


_ALPHABETS = ("0123456789abcdef", TOKEN_CHARS[:62], TOKEN_CHARS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", TOKEN_CHARS[26:52], TOKEN_CHARS[:52])


def fit(texts: Iterable[str], seed: int = 7, drawn: int = 900, made: int = 6000) -> Model:
    """drawn, made: numbers of random strings and of compounds."""
    rnd = random.Random(seed)
    secret = ["".join(rnd.choice(a) for _ in range(rnd.randint(20, 48))) for a in _ALPHABETS for _ in range(drawn // len(_ALPHABETS))]
    plain, found = list(IDENTIFIERS), []
    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            own = text[start:end]
            found.append(ASSIGN.search(own).group(2) if kind == 0 else own)
        cut = [0, *[x for s in spans for x in (s[0], s[2])], len(text)]
        for a, b in zip(cut[::2], cut[1::2], strict=True):
            plain += [x for x in _TOKEN.findall(text[a:b]) if not candidate(x)]
    secret += [x for x in found if set(x) <= set(TOKEN_CHARS)]
    words = [x for x in dict.fromkeys(plain) if x.isalpha() and len(x) <= 12]
    plain += compounds(WORDS, made // 2, seed) + (compounds([x.lower() for x in words], made // 2, seed + 1) if words else [])
    third = lambda x, own: [s for i, s in enumerate(x) if (i % 3 == 2) == own]
    ratio = _chain(third(secret, False)) - _chain(third(plain, False))
    free = Model(ratio, np.zeros((4, _LENGTHS + 1)))
    held = {x for x in third(plain, True) if len(x) >= SHORT}
    digits = sorted(free.score(x) for x in held if any(c.isdigit() for c in x))
    most = digits[int(0.99 * (len(digits) - 1))] if digits else 0.0  # the few above may be secrets that no pattern knows
    random_ = sorted(free.score(x) for x in third(secret, True) if len(x) >= LEAST and _mixed(x))
    low = random_[len(random_) // 50] if random_ else 1.0
    threshold = max(FLOOR, min(most, low))
    letters = max([threshold, *(free.score(x) for x in held if not any(c.isdigit() for c in x) and len(x) < 40)]) + 0.05
    limits = np.full((4, _LENGTHS + 1), np.inf)  # digits alone are numbers
    limits[2], limits[3] = letters, threshold
    for n in range(SHORT, LEAST):
        limits[3, n] = max(threshold, _passed(free, n, seed))
    return Model(ratio, limits)


def _passed(model: Model, n: int, seed: int, drawn: int = 300) -> float:
    """The score that 98 in 100 random strings of n characters reach, of the alphabet that scores least."""
    rnd, least = random.Random(seed * 1000 + n), []
    for a in _ALPHABETS[:4]:
        scores = sorted(model.score(x) for x in ("".join(rnd.choice(a) for _ in range(n)) for _ in range(drawn)) if _mixed(x))
        least.append(scores[len(scores) // 50])
    return min(least)


def spans(text: str, model: Model, candidates: bool = True, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted. A token that overlaps what a fixed pattern found is not told again."""
    base = base_spans(text, low) if candidates else []
    more = []
    for a, b in model.random_spans(text) if candidates else ():
        if not any(a < end and start < b for start, _, end in base):
            more.append((a, 3, b))
    return sorted(base + more)


OUT = "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _work(model: Model, redact: bool) -> Callable:
    def work(batches):
        for block in t.blocks(batches, t.BLOCK_BYTES // 4):  # the scores of its pairs take 60 times a block
            suspect = model.suspects(block.data, block.offs)
            found = t.words(block.data, block.offs, _INSIDE)
            long = np.flatnonzero(found.ends - found.starts >= LEAST)  # what a fixed pattern without a hint finds is as long
            suspect[np.searchsorted(found.offs, long, "right") - 1] = True
            data = block.data.tobytes()
            low = t.LOWER[block.data].tobytes()
            told, cleaned = [], []
            for i, (a, b) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True)):
                here = low[a:b]
                if suspect[i] or any(h in here for h in _BYTES):
                    text = data[a:b].decode("utf-8", "replace")
                    own = spans(text, model)
                else:
                    text, own = None, []
                told.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                if redact:
                    text = data[a:b].decode("utf-8", "replace") if text is None else text
                    cleaned.append(None if block.null[i] else redacted(text, own))
            if not redact:
                cleaned = [None] * len(told)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, mask=block.id_null), pa.array(told, _SPAN), pa.array(cleaned, pa.string())], names=["doc_id", "spans", "redacted"])

    return work


_BYTES = tuple(h.encode() for h in _HINTS)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each secret replaced by its kind in angle brackets; overlapping ones count as one of the first's kind."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with spans and the redacted text beside each row."""
    return t.beside(docs, _work(model, True), OUT, id_col, text_col, prefix)


def secret_scan(docs: DataFrame, sample_rows: int = 1500, redact: bool = True, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, spans (kind, start, end in code points, end exclusive; by start, then kind), redacted text.

    kinds: assign, access, hex (fixed patterns, leftmost, not overlapping within a kind), random (the models).
    sample_rows: texts that the models are fitted on, at most; every text is scanned whole. redact=False leaves
    redacted null. Null text: no spans, redacted null. Null ids, repeated rows and other columns don't matter. Empty
    table: no rows.
    """
    docs = t.id_text(docs, id_col, text_col)
    model = model or fit([x[2] for x in texts_of(docs, sample_rows)])
    return docs.mapInArrow(_work(model, redact), OUT)
