import hashlib
import random
import re

import duckdb
import pytest

from strandmill.llm import automaton, queries, secrets

from .conftest import TEXTS

LETTERS = {k: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")}
ASSIGN = re.compile(rf"""(?:{'|'.join(LETTERS.values())}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
OTHERS = [(3, r"gh[pousr]_[A-Za-z0-9]+", 40), (4, r"xox[abprs]-[A-Za-z0-9-]+", 15), (5, r"AIza[A-Za-z0-9_-]+", 39), (6, r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 24)]
_CLOSED = r"(?:(?!-----BEGIN |-----END [A-Z ]*PRIVATE KEY-----).)*-----END [A-Z ]*PRIVATE KEY-----"
OTHERS.append((7, rf"(?s)-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:{_CLOSED}|(?:[\r\n]+[A-Za-z0-9+/=]+)*)", 1))


def brute(t, all_kinds=True):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    for kind, pattern, least in [(1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24), *(OTHERS if all_kinds else [])]:
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return sorted(out)


def random_texts(n):
    rng = random.Random(1)
    parts = ["token", "TOKEN", "secret", "api_key", "apikey", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "a", "f0", "deadbeef", "é", "日", "\n"]
    parts += ["tok", "sec", "pass", "=", "abcdef", "1234567890abcdef12345678", "ghp_", "xoxb-", "A1b2C3d4E5f6G7h8I9j0" * 2, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----END ", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\nMIIe+/=", "-", "AIza", "sk_live_", "rk_test_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_random_texts():
    for t in random_texts(12000):
        assert secrets.spans(t) == brute(t), t


def test_spans_in_sql():
    texts = [*random_texts(4000), None, "-----BEGIN PRIVATE KEY-----BEGIN RSA PRIVATE KEY-----END PRIVATE KEY-----\nAB=", "x" * 5000 + " token=abcdef0123"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(?)) AS doc_id, unnest(?::VARCHAR[]) AS text", [len(texts), texts])
    got = {r[0]: r[5] for r in con.execute(queries.ORACLES["op3_secrets"]).fetchall()}
    for i, t in enumerate(texts):
        assert got[i] == secrets.shown(brute(t or "")), t


def test_edges(edge, empty):
    got = {}
    for r in secrets.find_secrets(edge).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in TEXTS:
        base = [x for x in brute(t or "") if x[1] < 3]
        digest = hashlib.sha256(secrets.shown(base).encode()).hexdigest()
        want = (*[sum(x[1] == k for x in base) for k in range(3)], digest, secrets.shown(brute(t or "")))
        assert want in got[i]
    assert sum(map(len, got.values())) == len(TEXTS)
    assert secrets.find_secrets(empty).count() == 0


def test_whole_table(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert secrets.spans(r["text"]) == brute(r["text"])


def test_redaction(spark, edge):
    assert secrets.redact("x token=abcdef0123456789abcdef0123 y", secrets.spans("x token=abcdef0123456789abcdef0123 y")) == "x [assign] y"
    got = secrets.redact_secrets(edge)
    assert got.schema == edge.schema and got.count() == edge.count()
    assert {r["text"] for r in got.where("doc_id = 9").collect()} == {"[assign]\" é [access], 日本 [hex]"}
    assert got.where("doc_id = 4 and text is null").count() == 1


def test_private_keys_go_with_their_bodies():
    body = "\n".join("MIIEpAIBAAKCAQEA" * 4 for _ in range(20))
    for kind in ("", "RSA ", "EC ", "ENCRYPTED "):
        closed = f"-----BEGIN {kind}PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END {kind}PRIVATE KEY-----"
        cut = f"-----BEGIN {kind}PRIVATE KEY-----\r\n{body}"
        text = f"first {closed}\nthen {cut}\nand some words {closed} last"
        assert secrets.redact(text, secrets.spans(text)) == "first [pem]\nthen [pem] some words [pem] last"


def random_pattern(rng, depth=2):
    parts = []
    for _ in range(rng.randint(1, 3)):
        one = rng.choice(["a", "b", "[ab]", "[^ab]", "[b-d]", r"\x61", r"\.", "c"])
        if depth and rng.random() < 0.4:
            one = f"({random_pattern(rng, depth - 1)}|{random_pattern(rng, depth - 1)})" if rng.random() < 0.5 else f"(?:{random_pattern(rng, depth - 1)})"
        parts.append(one + rng.choice(["", "", "?", "*", "+", "{2}", "{1,2}", "{2,}"]))
    return "".join(parts)


def test_position_automata_agree_with_regular_expressions():
    rng = random.Random(8)
    for _ in range(400):
        pattern = random_pattern(rng)
        nfa = automaton.Nfa(automaton.parse(pattern))
        for _ in range(30):
            t = "".join(rng.choice("abcd.") for _ in range(rng.randint(0, 8)))
            at = [0]
            for b in t.encode():
                at = nfa.step(at, b)
            assert bool(set(at) & nfa.done) == bool(re.fullmatch(pattern, t)), (pattern, t)
    for bad in ("(a", "a)", "[a", "*a", "a|*", r"\d"):
        with pytest.raises(ValueError):
            automaton.parse(bad)
    assert automaton.parse("aB", True) == ("cat", [("set", frozenset(b"aA")), ("set", frozenset(b"bB"))])


def test_automaton_is_small():
    a = secrets.automaton()
    assert a.states <= a.raw_states < 2000
