"""Secret scans: every rule in one automaton, one pass over each text's bytes."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import map_rows, text_of
from .automaton import Automaton, Rule

_CLOSES = re.compile(rb"-----(END [A-Z ]*PRIVATE KEY-----|BEGIN )")
_BODY = re.compile(rb"(?:[\r\n]+[A-Za-z0-9+/=]+)*")


def _key_block(data: bytes, end: int) -> int:
    """The end of a private key whose opening line ends at end: after its closing line, or, where none comes before another
    opening, after the lines of base64 that follow."""
    m = _CLOSES.search(data, end)
    return m.end() if m and m[1] != b"BEGIN " else _BODY.match(data, end).end()


#: In this order within one start. The first three are the base kinds.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", either_case=True, min_last=6),
    Rule("access", "AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", "[0-9a-f]{8,}", min_length=24),  # 24 counted places would multiply with the states of all other rules
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", min_length=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]+", min_length=24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", until=_key_block),
]
BASE = 3
KINDS = [r.kind for r in RULES]

_made: list[Automaton] = []


def automaton() -> Automaton:
    """Compiled once a process."""
    if not _made:
        _made.append(Automaton(RULES))
    return _made[0]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start, then rule; whole text."""
    data = text.encode()
    found = automaton().find(data)
    if len(data) == len(text) or not found:
        return found
    at, point, where = 0, 0, {}
    for p in sorted({x for s, _, e in found for x in (s, e)}):
        point += len(data[at:p].decode())
        at = p
        where[p] = point
    return [(where[s], i, where[e]) for s, i, e in found]


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[i]}:{s}:{e}" for s, i, e in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, gives way to the first one's kind in brackets."""
    out, at = [], 0
    for s, i, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[i]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(batches):
    for b in batches:
        found = [spans(t) for t in b.column(1).to_pylist()]
        base = [[x for x in f if x[1] < BASE] for f in found]
        counts = [[sum(x[1] == i for x in f) for f in base] for i in range(BASE)]
        digests = [hashlib.sha256(shown(f).encode()).hexdigest() for f in base]
        cols = [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([shown(f) for f in found], pa.string())]
        yield pa.record_batch(cols, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, SHA-256 of the base spans, all spans.

    Null and empty texts have no spans. Null ids and repeated rows come back as they are; an
    empty table gives no rows; other columns are ignored. Spans of one kind never overlap;
    spans that start together come in the order of the rules.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text")).mapInArrow(
        _scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return out.withColumnRenamed("id", id_col)


def _redact(at: int):
    def run(batches):
        for b in batches:
            texts = [None if t is None else redact(t, spans(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and rows of docs, with every secret in the text replaced by its kind in brackets; null stays null."""
    return map_rows(docs, _redact(docs.columns.index(text_col)))
