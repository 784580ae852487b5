"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import ann as _ann
from . import exact_dedup as _exact
from . import hard_negatives as _hard
from . import licenses as _licenses
from . import line_dedup as _lines
from . import packing as _packing
from . import pieces as _pieces
from . import quality as _quality
from . import secrets as _secrets
from . import simhash as _simhash
from . import token_shards as _shards
from . import url_rules as _urls
from . import vector_codes as _codes
from ._work import new_path, spread, table, vocabulary


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def op1_adaptive_scan(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return _ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_simhash(spark, sf_dir):
    return _simhash.near_dups(_documents(spark, sf_dir))


def op3_secrets(spark, sf_dir):
    return _secrets.find_secrets(_documents(spark, sf_dir))


def op4_line_dedup(spark, sf_dir):
    out = _lines.line_dedup(_documents(spark, sf_dir), digest=True)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept").alias("kept_sha256"))


def op5_quality(spark, sf_dir):
    return _quality.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_token_shards(spark, sf_dir):
    path = new_path(spark, "tokens")
    _shards.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return _shards.describe(spark, path).withColumnRenamed("key", "doc_id")


def op7_sampled_pieces(spark, sf_dir):
    return _pieces.sample_pieces(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return _urls.filter_urls(pages, _urls.mine(pages, table(spark, sf_dir, "labels")))


def op10_packing(spark, sf_dir):
    return _packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op11_license_scan(spark, sf_dir):
    return _licenses.scan(_documents(spark, sf_dir))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return _hard.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


def op13_vector_codes(spark, sf_dir):
    return _codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_token_shards": op6_token_shards,
    "op7_sampled_pieces": op7_sampled_pieces,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_rules": op9_url_rules,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

_SP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    """Blocks and templates by brute force: all pairs of one size."""
    found = _licenses.templates_of()
    terms = ", ".join(f"({i}, '{t.label}', {t.size}, {t.need}, {len(t.words)}, {sorted(t.words)})" for i, t in enumerate(found))
    base = " UNION ALL ".join(
        f"SELECT a0.doc_id, a0.p, '{label}' AS label FROM " + " JOIN ".join(f"n a{i}" + (f" ON a{i}.doc_id = a0.doc_id AND a{i}.p = a0.p + {i} AND a{i}.w = '{w}'" if i else "") for i, w in enumerate(ws)) + f" WHERE a0.w = '{ws[0]}'"
        for phrase, label in _licenses.PHRASES
        for ws in [_licenses.words(phrase)]
    )
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
t AS (SELECT * FROM (VALUES {terms}) AS v(i, label, size, need, n, ws)),
tw AS (SELECT i, label, size, need, n, unnest(ws) AS w FROM t),
n AS MATERIALIZED (SELECT * FROM u WHERE w IN (SELECT w FROM tw) OR w IN ('general', 'public', 'license', 'mit', 'apache')),
k AS (SELECT DISTINCT doc_id, size, b, w FROM (SELECT doc_id, s.size, unnest([p // s.size, p // s.size - 1]) AS b, w FROM n, (SELECT DISTINCT size FROM t) s) WHERE b >= 0),
m AS (SELECT doc_id, label, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM k JOIN tw USING (size, w) GROUP BY doc_id, label, i, k.size, b HAVING count(*) >= any_value(need)),
ml AS (SELECT doc_id, max(share) AS share FROM m GROUP BY 1),
bp AS ({base}),
bs AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bp GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bp UNION ALL SELECT doc_id, label FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN ml USING (doc_id)"""


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""


def _codes_sql(parts: int = 4, rounds: int = 4, entries: int = 256) -> str:
    """Every distance of every round."""
    measured = "SELECT vec_id, p, arg_min(i, (far, i)) AS i, min(far) AS far FROM (SELECT x.vec_id, x.p, c.i, list_sum(list_transform(list_zip(x.e, c.e), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS far FROM x JOIN {} c USING (p)) GROUP BY ALL"
    steps = []
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({measured.format(f'c{r}')})",
            f"u{r} AS (SELECT p, i, pos, floor(sum(y) / CAST(count(*) AS DOUBLE))::BIGINT AS y FROM (SELECT a.p, a.i, unnest(x.e) AS y, generate_subscripts(x.e, 1) AS pos FROM a{r} a JOIN x USING (vec_id, p)) GROUP BY ALL)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.i, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT p, i, list(y ORDER BY pos) AS e FROM u{r} GROUP BY ALL) n USING (p, i))",
        ]
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT vec_id, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS e FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, i, e FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v QUALIFY i < {entries}) USING (vec_id)),
{', '.join(steps)},
z AS ({measured.format(f'c{rounds}')}),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM z JOIN v USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) FROM c{rounds}) AS codebooks_sha256 FROM o"""


#: The hash's fixed multipliers.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_WORD = "18446744073709551615::UHUGEINT"


def _fingerprint_sql(shingle: int = _simhash.SHINGLE, radius: int = _simhash.RADIUS, seed: int = _simhash.SEED) -> str:
    """XXH64 of every different shingle, spelled out: t is its bytes from last to first in hexadecimal, n their number, o how
    many are done. Stripes of 32 bytes go by recursion, what is left of them by steps; all pairs of fingerprints."""
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in _PRIMES)
    cut = lambda x: f"(({x}) & {_WORD})"
    turn = lambda x, r: f"(({x} << {r} & {_WORD}) | ({x} >> {64 - r}))"
    read = lambda size, at="o": f"TRY_CAST('0x' || substr(t, 2 * (n - ({at}) - {size}) + 1, {2 * size}) AS UBIGINT)::UHUGEINT"
    mixed = lambda v, x: cut(f"{turn(cut(f'{v} + {cut(f"{x} * {p2}")}'), 31)} * {p1}")
    lanes = ("v1", "v2", "v3", "v4")
    steps, cols = [], ["t", "n", "o", *lanes, "h"]

    def step(**to):
        steps.append(f"x{len(steps) + 1} AS (SELECT s, {', '.join(f'{to.get(c, c)} AS {c}' for c in cols)} FROM x{len(steps)})")

    def part(size: int, xor: str, then: str):
        """One more of that size, where as many are left."""
        step(h=f"CASE WHEN o + {size} <= n THEN xor(h, {xor}) ELSE h END", o=f"CASE WHEN o + {size} <= n THEN -(o + {size}) ELSE o END")
        step(h=f"CASE WHEN o < 0 THEN {then} ELSE h END", o="abs(o)")

    step(h=f"CASE WHEN n >= 32 THEN {cut(' + '.join(turn(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True)))} ELSE {(seed + _PRIMES[4]) & (1 << 64) - 1}::UHUGEINT END")
    for v in lanes:
        step(h=f"CASE WHEN n >= 32 THEN {cut(f'xor(h, {mixed("0::UHUGEINT", v)}) * {p1} % 18446744073709551616::UHUGEINT + {p4}')} ELSE h END")
    step(h=cut("h + n::UHUGEINT"))
    for _ in range(3):
        part(8, mixed("0::UHUGEINT", read(8)), cut(f"{cut(f'{turn("h", 27)} * {p1}')} + {p4}"))
    part(4, cut(f"{read(4)} * {p1}"), cut(f"{cut(f'{turn("h", 23)} * {p2}')} + {p3}"))
    for _ in range(3):
        part(1, cut(f"{read(1)} * {p5}"), cut(f"{turn('h', 11)} * {p1}"))
    step(h=cut(f"xor(h, h >> 33) * {p2}"))
    step(h=cut(f"xor(h, h >> 29) * {p3}"))
    step(h="xor(h, h >> 32)")
    starts = [(seed + _PRIMES[0] + _PRIMES[1]), seed + _PRIMES[1], seed, seed - _PRIMES[0]]
    bits = " + ".join(f"CASE WHEN 2 * sum(k * CAST(h >> {b} & 1 AS BIGINT)) > sum(k) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
g AS MATERIALIZED (SELECT doc_id, array_to_string(ws[i : i + {shingle - 1}], ' ') AS s, count(*) AS k FROM w GROUP BY ALL),
b AS (SELECT s, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS t FROM (SELECT DISTINCT s FROM g)),
r AS (SELECT s, t, length(t) // 2 AS n, 0::BIGINT AS o, {', '.join(f'{x & (1 << 64) - 1}::UHUGEINT AS {v}' for v, x in zip(lanes, starts, strict=True))} FROM b
  UNION ALL SELECT s, t, n, o + 32, {', '.join(mixed(v, read(8, f'o + {8 * i}')) for i, v in enumerate(lanes))} FROM r WHERE o + 32 <= n),
x0 AS MATERIALIZED (SELECT *, 0::UHUGEINT AS h FROM r WHERE o + 32 > n),
{', '.join(steps)},
hs AS MATERIALIZED (SELECT s, h FROM x{len(steps)}),
f AS MATERIALIZED (SELECT d.doc_id, coalesce(z.fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT doc_id, CAST({bits} AS UBIGINT) AS fp FROM g JOIN hs USING (s) GROUP BY 1) z USING (doc_id)),
l AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM f GROUP BY 1),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM l a, l b WHERE bit_count(xor(a.fp, b.fp)) <= {radius}),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN (SELECT a AS fp, min(low) AS component_id FROM c JOIN l ON l.fp = c.b GROUP BY 1) USING (fp)"""



def _secrets_sql() -> str:
    """Every kind by its regular expression, places from the lengths between matches; private keys one after the other."""

    def pattern(rule):
        named, rest = (rule.pattern[: (at := rule.pattern.index(")") + 1)], rule.pattern[at:]) if rule.either_case else ("", rule.pattern)
        named = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", named)
        head, _, last = (named + rest).rpartition("(") if rule.min_last else (named + rest, "", "")
        return (head.replace("(", "(?:") + (f"({last}" if last else "")).replace("'", "''")

    rules = list(enumerate(_secrets.RULES))
    plain = " UNION ALL ".join(
        f"SELECT nr, {i} AS kind, {r.min_length} AS least, list_transform(regexp_split_to_array(text, '{pattern(r)}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, '{pattern(r)}'), lambda x: length(x)) AS ms, "
        + (f"list_transform(regexp_extract_all(text, '{pattern(r)}', 1), lambda x: length(x) >= {r.min_last})" if r.min_last else "NULL::BOOLEAN[]")
        + " AS fits FROM d"
        for i, r in rules
        if r.until is None
    )
    [(pem, key)] = [(i, pattern(r)) for i, r in rules if r.until is not None]
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS nr, coalesce(text, '') AS text FROM documents),
m AS ({plain}),
u AS (SELECT nr, kind, least, generate_subscripts(ms, 1) AS i, unnest(gaps[1 : len(ms)]) AS gap, unnest(ms) AS size, unnest(coalesce(fits, list_transform(ms, lambda x: true))) AS fits FROM m),
p AS (SELECT nr, kind, sum(gap + size) OVER (PARTITION BY nr, kind ORDER BY i) - size AS start, size FROM u QUALIFY fits AND size >= least),
k AS (SELECT nr, text AS rest, 0 AS start, 0 AS stop FROM d WHERE contains(text, '-----BEGIN ')
  UNION ALL SELECT nr, substr(after, length(body) + 1), stop + before, stop + before + head + length(body) FROM (
    SELECT *, CASE WHEN closed <> '' THEN closed ELSE regexp_extract(after, '^(?:[\\r\\n]+[A-Za-z0-9+/=]+)*') END AS body FROM (
      SELECT *, regexp_extract(CASE WHEN contains(after, '-----BEGIN ') THEN split_part(after, '-----BEGIN ', 1) || '-----' ELSE after END, '^[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----') AS closed FROM (
        SELECT nr, stop, length(regexp_extract(rest, '^([\\s\\S]*?){key}', 1)) AS before, length(regexp_extract(rest, '{key}')) AS head, substr(rest, length(regexp_extract(rest, '^[\\s\\S]*?{key}')) + 1) AS after
        FROM k WHERE regexp_matches(rest, '{key}'))))),
a AS (SELECT nr, kind, start, start + size AS stop FROM p UNION ALL SELECT nr, {pem}, start, stop FROM k WHERE stop > 0),
s AS (SELECT nr, kind, start, {_secrets.KINDS}[kind + 1] || ':' || start || ':' || stop AS span FROM a),
o AS (SELECT nr, string_agg(span, ',' ORDER BY start, kind) AS spans, string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < {_secrets.BASE}) AS base, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(_secrets.KINDS[: _secrets.BASE]))} FROM s GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _secrets.KINDS[: _secrets.BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (nr)"""



ORACLES = {
    "op2_simhash": _fingerprint_sql(),
    "op3_secrets": _secrets_sql(),
    "op4_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_SP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.last AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op8_exact_dedup": f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(translate(coalesce(text, ''), {_SP}, '')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op11_license_scan": _license_sql(),
    "op12_hard_negatives": _NEGATIVES_SQL,
    "op13_vector_codes": _codes_sql(),
}
