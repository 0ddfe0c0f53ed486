"""The models of secrets on labels that they haven't learned from."""

import hashlib
import random
import re

import pytest

from kinfold.llm import secret_scan
from kinfold.llm.queries import op3_secret_scan

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.fit([r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()])


def strings(alphabet, n, count=300, seed=99):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(count)]


@pytest.mark.parametrize("alphabet, n, share", [("0123456789abcdef", 22, 0.95), (secret_scan.TOKEN_CHARS[:62], 24, 0.97), (secret_scan.TOKEN_CHARS[:62], 14, 0.85), (secret_scan.TOKEN_CHARS[:52], 24, 0.9), (secret_scan.TOKEN_CHARS[26:52], 32, 0.8)])
def test_recall(model, alphabet, n, share):
    """Of random strings, those of letters alone among them."""
    assert sum(model.random(x) for x in strings(alphabet, n)) >= share * 300


def test_precision(model):
    """Of ordinary identifiers of other words than the models know."""
    words = "banana harbor quantum velvet whisper pencil gravel thunder meadow copper lantern orchard puzzle ribbon saddle tunnel".split()
    own = [x for x in secret_scan.compounds(words, 3000, 1234) if len(x) >= 12]
    assert sum(model.random(x) for x in own) <= 0.01 * len(own)
    known = ["getUserAccountByEmailAddress2", "content-security-policy-level-3", "123e4567-e89b-12d3-a456-426614174000", "how-to-train-your-model-in-10-steps", "2024-05-17-my-first-post", "Donaudampfschifffahrtsgesellschaft", "internationalization", "1234567890123456", "====================", "--------------------"]
    assert not any(model.random(x) for x in known)


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_base_against_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in op3_secret_scan(spark, FOLDER).collect():
        base = brute_base(texts[r.doc_id])
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_all_at_once_as_one_by_one(spark, model):
    """Texts with random tokens anywhere, of odd characters, long and repeated; null ids and clashing columns."""
    random_ = strings(secret_scan.TOKEN_CHARS[:62], 20, 6)
    texts = [f"é{random_[0]}ü", random_[1], f"/{random_[2]}=x", f"a {random_[3]}.{random_[4]}", "x" * 200_000 + " " + random_[5], "", None, "plain words only"]
    rows = [(i if i else None, x) for i, x in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS redacted", "'k' AS kind")
    got = secret_scan.secret_scan(docs, model=model).collect()
    assert len(got) == len(rows)
    want = {x: len(secret_scan.spans(x or "", model)) for x in texts}
    assert sum(want.values()) >= 5
    for r in got:
        i = (r.doc_id or 0) % len(texts)
        assert len(r.spans) == want[texts[i]] and (r.redacted is None) == (texts[i] is None)
