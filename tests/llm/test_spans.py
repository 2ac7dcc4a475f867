"""Secrets and personal data: base spans next to the plain patterns of the contract, and what the methods add."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from urlrisk.llm import pii, secret_scan
from urlrisk.llm.common import ascii_view
from urlrisk.llm.spans import digest_columns

DOCS = "/root/testdata/sf0.01/documents.parquet"


def letters(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def count(s):
    return sum(c in "0123456789" for c in s)


PATTERNS = {
    "secrets": {"assign": (ASSIGN, lambda m: len(m[2]) >= 8), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32)},
    "pii": {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
            "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= count(m[0]) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))),
            "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= count(m[0]) <= 15)}}


def brute(text, which):
    out = []
    for order, (kind, (pattern, good)) in enumerate(PATTERNS[which].items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


PIECES = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "APIkey", "paſsword", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef",
          "a", "é", "ß", "𝒳", "Z9", "@", ".", "..", "-", "_", "mail", "x.org", "10", "255", "256", "001", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+", "+1", "(555)", "123-4567", "+49 30 1234567", "\n", "78-12-3456"]


def random_texts(n=4000):
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_base_spans_equal_the_plain_patterns():
    for text in random_texts():
        view = ascii_view(text)
        order = {k: i for i, k in enumerate((*secret_scan.KINDS, *pii.KINDS))}
        for which, found in (("secrets", secret_scan.base_spans(view)), ("pii", pii.base_spans(view))):
            assert sorted(found, key=lambda s: (s[1], order[s[0]])) == brute(text, which), text


def test_long_runs_take_linear_time():
    for unit in ("1", "a", "9.", "a.", "+1", "@", "1 ", "token=", "AKIA", "password  ", "é", "f", "-1", "A1"):
        text = unit * (600_000 // len(unit))
        pii.scan(text[:200_000] if unit in ("1 ", "-1") else text)
        secret_scan.Scanner().scan(text)
    assert [s["kind"] for s in pii.scan("at " + "0" * 5000 + "1.2.3.4 now")] == ["ip"]


def test_queries_equal_brute_force_on_given_documents(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for which, module in (("secrets", secret_scan), ("pii", pii)):
        found = module.find(docs).select("doc_id", *digest_columns(module.KINDS)).collect()
        assert len(found) == len(texts)
        for row in found:
            want = brute(texts[row["doc_id"]], which)
            assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
            assert [row[f"n_{k}"] for k in module.KINDS] == [sum(w[0] == k for w in want) for k in module.KINDS]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row["spans"].split(",")) | {""}


def test_awkward_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, None, 3), (2, "mail a@b.org", 4), (2, "mail a@b.org", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    for module in (secret_scan, pii):
        found = module.find(docs)
        assert found.count() == 5 and found.where(F.size("spans") == 0).count() >= 3
        assert module.find(docs.limit(0)).count() == 0


def entropy(piece):
    p = np.unique(list(piece), return_counts=True)[1] / len(piece)
    return float(-(p * np.log2(p)).sum())


def test_incremental_entropy_equals_entropy_of_every_window():
    rng = random.Random(9)
    for alphabet in ("ab", "0123456789abcdef", secret_scan.LOWER + secret_scan.UPPER):
        piece = "".join(rng.choice(alphabet) for _ in range(300)) + "a" * 40
        for window, bits in ((20, 3.0), (24, 4.0), (20, 0.9)):
            inside = set()
            for at in range(len(piece) - window + 1):
                if entropy(piece[at:at + window]) >= bits - 1e-12:
                    inside.update(range(at, at + window))
            found = {i for a, b in secret_scan.hot_windows(piece.encode(), window, bits) for i in range(a, b)}
            assert found == inside


def test_entropy_spans_and_allow_list():
    scan = secret_scan.Scanner().scan
    key = "Zx8kQ2vLm9TfR4wYb7NpJc3HsD6gEa1U"
    assert [(s["kind"], s["start"], s["end"]) for s in scan(f"use {key} here")] == [("entropy", 4, 4 + len(key))]
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "thesonouingthterhanreedonwh" * 3, "EXAMPLEKEYzx8kQ2vLm9TfR4wYb7N", "a-long-path/of-many-words/that-goes-on4", "4111111111111111111111"):
        assert not [s for s in scan(f"see {clean} here") if s["kind"] == "entropy"], clean
    assert [s["kind"] for s in scan(f"token={key}")] == ["assign"]  # reported once


def test_keys_glued_to_allowed_text_and_to_base_spans():
    scan = secret_scan.Scanner().scan
    key = "Zx8kQ2vLm9TfR4wYb7NpJc3HsD6gEa1U"
    for before in ("backup/2024-05-01/", "path/to/file/", "sample=", "objects/123e4567-e89b-12d3-a456-426614174000/"):
        spans = [s for s in scan(f"see {before}{key} here") if s["kind"] == "entropy"]
        at = 4 + len(before)
        assert [s["end"] for s in spans] == [at + len(key)] and at - 1 <= spans[0]["start"] <= at, (before, spans)
    for middle in ("xxxxxx", "00000000"):
        spans = scan(key + middle + key)
        # The mask is no part of a span, whatever it is cut out of.
        assert [(s["start"], s["end"]) for s in spans] == [(0, len(key)), (len(key + middle), 2 * len(key) + len(middle))], spans
    access = "AKIA" + "ABCDEFGH1234"
    spans = scan(f"{key}+{access}+{key}")
    assert [s["kind"] for s in spans] == ["entropy", "access", "entropy"]
    assert all(b["start"] >= a["end"] for a, b in zip(spans, spans[1:]))
    for clean in ("0123456789abcdefghijklmnopqrstuvwxyz", secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGITS + "+/", "path/to/file/of-many-words/readme12", "123e4567-e89b-12d3-a456-426614174000/v1"):
        assert not [s for s in scan(f"see {clean} here") if s["kind"] == "entropy"], clean


def test_mixed_keys_of_the_least_length():
    scan = secret_scan.Scanner().scan
    key = "Zx8kQ2vLm9TfR4wYb7NpJc3H"
    for n in range(secret_scan.LEAST_CANDIDATE, 25):
        assert [(s["kind"], s["start"], s["end"]) for s in scan(f"use {key[:n]} here")] == [("entropy", 4, 4 + n)]


def test_long_candidates_take_linear_time():
    key = "Zx8kQ2vLm9TfR4wYb7NpJc3HsD6gEa1U"
    for text in ("a" * 300_000 + "1" + key, key + "example" * 40_000, (key + "/") * 5_000, (key + "/AKIAABCDEFGH1234/") * 3_000):
        secret_scan.Scanner().scan(text)


def test_labelers_agree_on_planted_spans(spark):
    rng = random.Random(1)
    texts = [f"call me on phone {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} today" for _ in range(60)]
    texts += [f"part no {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}-x of the order" for _ in range(60)]
    texts += ["my name is Maria Lopez and my ssn is 123-45-6789", "iban DE89 3704 0044 0532 0130 00 at the bank"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(docs).collect()}
    assert all(kinds[i] == ["tel"] for i in range(60))
    assert not any(kinds[i] for i in range(60, 120))
    assert kinds[120] == ["name", "ssn"] and "iban" in kinds[121]


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(2)
    real = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < right, real, ~real) * 2 - 1 for right in (0.95, 0.8, 0.6)], axis=1)
    v, n = np.unique(votes, axis=0, return_counts=True)
    _, share, yes = pii.reliabilities(v, n.astype(float), 200)
    assert abs(share - 0.6) < 0.06
    assert yes[0][0] > yes[0][1] > yes[0][2] and abs(yes[0][0] - 0.95) < 0.05
