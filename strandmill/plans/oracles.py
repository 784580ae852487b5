"""DuckDB SQL for the queries, over whole tables. Hashed sketches spell out the hash function in unsigned 128-bit integers."""

from __future__ import annotations

from dataclasses import replace

from ..params import max_hash
from .file_queries import KEPT, TRIMMED
from .queries import DOC_MASHED, FILTERS, LONG, MASHED, SCALING, SHORT, SMALL_SCALE


def _encoded() -> str:
    out = "translate(hex(encode(coalesce(text, ''))), '0123456789ABCDEF', 'abcdefghijklmnop')"
    for i, c in enumerate("abcdefghijklmnop"):
        out = f"replace({out}, '{c}', '{'ACGT'[i // 4]}{'ACGT'[i % 4]}')"
    return out


def _digits(x: str, k: int) -> list[str]:
    return [f"(({x} // {4 ** (k - 1 - i)}) % 4)" for i in range(k)]


def _base(k: int, by: str) -> str:
    """CTEs up to r(sample, h, kmer, n, extra)."""
    ix = " + ".join(f"lead(c, {i}) OVER w * {4 ** (k - 1 - i)}" if i else f"c * {4 ** (k - 1)}" for i in range(k))
    rc = " + ".join(f"(3 - {d}) * {4**i}" for i, d in enumerate(_digits("ix", k)))
    kmer = " || ".join(f"substr('ACGT', CAST({d} + 1 AS BIGINT), 1)" for d in _digits("h", k))
    return f"""
WITH s AS (SELECT CAST({by} AS VARCHAR) AS sample, doc_id, string_split({_encoded()}, '') AS b FROM documents),
c AS (SELECT sample, doc_id, unnest(b) AS ch, generate_subscripts(b, 1) AS i FROM s),
d AS (SELECT sample, doc_id, i, CAST(instr('ACGT', ch) - 1 AS BIGINT) AS c FROM c WHERE ch <> ''),
w AS (SELECT sample, {ix} AS ix FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT sample, ix, count(*) AS c FROM w WHERE ix IS NOT NULL GROUP BY ALL),
q AS (SELECT sample, ix, c, {rc} AS rc FROM p),
f AS (SELECT sample, least(ix, rc) AS lo, max(greatest(ix, rc)) AS hi, sum(CASE WHEN ix <= rc THEN c ELSE 0 END) AS cl, sum(CASE WHEN ix > rc THEN c ELSE 0 END) AS ch FROM q GROUP BY 1, 2),
g AS (SELECT sample, CASE WHEN cl = 0 THEN hi ELSE lo END AS h,
  CAST(CASE WHEN lo = hi THEN 2 * cl ELSE cl + ch END AS BIGINT) AS n,
  CAST(CASE WHEN lo = hi THEN cl WHEN cl = 0 THEN 0 ELSE ch END AS BIGINT) AS extra FROM f),
r AS MATERIALIZED (SELECT sample, h, {kmer} AS kmer, n, extra FROM g)"""


_WORD = "18446744073709551615::UHUGEINT"


def _mul(x: str, c: int) -> str:
    return f"(({x}) * {c}::UHUGEINT & {_WORD})"


def _turn(x: str, r: int) -> str:
    return f"((({x}) << {r} & {_WORD}) | (({x}) >> {64 - r}))"


def _text_word(k: int, at: int) -> str:
    """Bytes at to at + 7 of the k-mer h's text as a little-endian word."""
    letter = "CASE {} WHEN 0 THEN 65 WHEN 1 THEN 67 WHEN 2 THEN 71 ELSE 84 END"
    return " + ".join(f"({letter.format(d)})::UHUGEINT * {256**i}::UHUGEINT" for i, d in enumerate(_digits("h", k)[at : at + 8]))


#: The hash's fixed multipliers and increments.
_C1, _C2, _N1, _N2, _F1, _F2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _hashed(by: str, k: int = 21) -> str:
    """CTEs up to g(sample, h, n, extra, hash): the k-mer as a 2-bit number, its counts, and the hash of its text; 16 < k < 24.

    A text's byte gives four bases, so six bytes hold the four k-mers that begin in the first of them."""
    six = " + ".join(f"lead(c, {i}) OVER w * {256 ** (5 - i)}" if i else f"c * {256**5}" for i in range(6))
    rc = " + ".join(f"(3 - {d}) * {4**i}" for i, d in enumerate(_digits("f", k)))
    steps, cols = [], []

    def step(**new):
        """One more CTE; the columns that the new ones replace go."""
        kept = [c for c in cols if c not in new]
        name, src = f"m{len(steps) + 1}", f"m{len(steps)}"
        steps.append(f"{name} AS (SELECT h, {', '.join([*kept, *(f'{x} AS {c}' for c, x in new.items())])} FROM {src})")
        cols[:] = [*kept, *new]

    step(a=_text_word(k, 0), b=_text_word(k, 8), t=_text_word(k, 16))
    step(a=_mul("a", _C1), b=_mul("b", _C2), t=_mul("t", _C1))
    step(a=_mul(_turn("a", 31), _C2), b=_mul(_turn("b", 33), _C1), t=_mul(_turn("t", 31), _C2))
    step(a=f"({_turn('a', 27)} * 5 + {_N1}) & {_WORD}", b="b", t="t")
    step(a="a", b=f"(({_turn('b', 31)} + a & {_WORD}) * 5 + {_N2}) & {_WORD}", t="t")
    step(a=f"xor(xor(a, t), {k}::UHUGEINT)", b=f"xor(b, {k}::UHUGEINT)")
    step(a=f"(a + b) & {_WORD}", b="b")
    step(a="a", b=f"(a + b) & {_WORD}")
    for c in (_F1, _F2):
        step(a=_mul("xor(a, a >> 33)", c), b=_mul("xor(b, b >> 33)", c))
    step(hash=f"(xor(a, a >> 33) + xor(b, b >> 33)) & {_WORD}")
    return f"""
WITH s AS (SELECT CAST({by} AS VARCHAR) AS sample, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
c AS (SELECT sample, doc_id, unnest(b) AS ch, generate_subscripts(b, 1) AS i FROM s),
d AS (SELECT sample, doc_id, i, CAST((instr('0123456789ABCDEF', ch[1]) - 1) * 16 + instr('0123456789ABCDEF', ch[2]) - 1 AS BIGINT) AS c FROM c),
w AS (SELECT sample, {six} AS v FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT sample, (v >> j) & {4**k - 1} AS f, count(*) AS n FROM w, (SELECT unnest([{', '.join(str(2 * (24 - k - i)) for i in range(4))}]) AS j) WHERE v IS NOT NULL GROUP BY ALL),
q AS (SELECT sample, f, n, {rc} AS rc FROM p),
o AS MATERIALIZED (SELECT sample, least(f, rc) AS h, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN f >= rc THEN n ELSE 0 END) AS BIGINT) AS extra FROM q GROUP BY 1, 2),
m0 AS (SELECT DISTINCT h FROM o),
{', '.join(steps)},
g AS (SELECT sample, h, n, extra, hash FROM o JOIN m{len(steps)} USING (h))"""


def _smallest(by: str, params) -> str:
    """CTEs up to r(sample, h, kmer, n, extra) of sketches of the smallest hashes, h being the hash."""
    k = params.kmer_length
    kmer = " || ".join(f"substr('ACGT', CAST({d} + 1 AS BIGINT), 1)" for d in _digits("v", k))
    low = f" OR hash <= {max_hash(params.scale)}" if params.scale is not None else ""
    return f"""{_hashed(by, k)},
t AS (SELECT sample, h AS v, n, extra, hash, row_number() OVER (PARTITION BY sample ORDER BY hash) AS rn FROM g),
r AS MATERIALIZED (SELECT sample, hash AS h, {kmer} AS kmer, n, extra FROM t WHERE rn <= {params.kmers_to_sketch}{low})"""


_ROWS = 'SELECT sample, CAST(h AS VARCHAR) AS hash, kmer, n AS "count", extra AS extra_count'
_DENSE = """,
hd AS (SELECT sample, n AS depth, count(*) AS n FROM {src} GROUP BY ALL),
top AS (SELECT sample, max(depth) AS l, sum(depth * n) AS total FROM hd GROUP BY 1),
ix AS (SELECT sample, l, total, unnest(range(0, l)) AS i FROM top),
h AS (SELECT ix.sample, ix.i, l, total, CAST(coalesce(hd.n, 0) AS BIGINT) AS n FROM ix LEFT JOIN hd ON hd.sample = ix.sample AND hd.depth = ix.i + 1),
cu AS (SELECT *, sum(i * n) OVER o AS cum, sum(n) OVER o AS upto FROM h WINDOW o AS (PARTITION BY sample ORDER BY i)),
ws AS (SELECT sample, count(*) FILTER (WHERE cum <= {level} * total) AS w FROM cu GROUP BY 1),
wn AS (SELECT sample, w, greatest(1, w // 20) AS win FROM ws),
st AS (SELECT cu.sample, cu.i, e.upto - cu.upto + cu.n AS s, w, win FROM cu JOIN wn USING (sample) JOIN cu e ON e.sample = cu.sample AND e.i = cu.i + win - 1 WHERE cu.i < w - win),
be AS (SELECT sample, i + win + 1 AS t FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY s, i DESC) AS rn FROM st) WHERE rn = 1),
th AS (SELECT wn.sample, CAST(CASE WHEN w = 0 THEN 1 WHEN be.t IS NULL THEN win ELSE be.t END AS BIGINT) AS threshold FROM wn LEFT JOIN be USING (sample))"""


def _distances(pick: str = "TRUE", old: bool = False, k: int = LONG, scale: float | None = None) -> str:
    """CTEs after r up to x: the result's columns."""
    low = f" OR r.h < {max_hash(scale)}" if scale is not None else ""
    if old:
        measured = "CAST(common AS DOUBLE) / rt AS containment, CAST(common AS DOUBLE) / (common + 2 * (rt - common)) AS jaccard, common AS commonHashes, rt AS totalHashes"
    else:
        measured = "CASE WHEN j = 0 THEN 0.0 ELSE CAST(common AS DOUBLE) / j END AS containment, CASE WHEN i - common + j = 0 THEN 1.0 ELSE CAST(common AS DOUBLE) / (i - common + j) END AS jaccard, common AS commonHashes, i - common + j AS totalHashes"
    return f""",
mx AS (SELECT sample, max(h) AS m, count(*) AS t FROM r GROUP BY 1),
pr AS (SELECT a.sample AS q, b.sample AS ref, least(a.m, b.m) AS m, b.t AS rt FROM mx a, mx b WHERE a.sample <> b.sample AND ({pick})),
cm AS (SELECT a.sample AS q, b.sample AS ref, count(*) AS common FROM r a JOIN r b ON a.h = b.h GROUP BY 1, 2),
qi AS (SELECT pr.q, pr.ref, count(*) AS i FROM pr JOIN r ON r.sample = pr.q AND (r.h <= pr.m{low}) GROUP BY 1, 2),
rj AS (SELECT pr.q, pr.ref, count(*) AS j FROM pr JOIN r ON r.sample = pr.ref AND (r.h <= pr.m{low}) GROUP BY 1, 2),
y AS (SELECT pr.q AS query, pr.ref AS reference, coalesce(common, 0) AS common, coalesce(i, 0) AS i, coalesce(j, 0) AS j, rt
  FROM pr LEFT JOIN cm USING (q, ref) LEFT JOIN qi USING (q, ref) LEFT JOIN rj USING (q, ref)),
z AS (SELECT query, reference, {measured} FROM y),
x AS (SELECT query, reference, containment, jaccard, round(CASE WHEN jaccard = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, -ln(2.0 * jaccard / (1.0 + jaccard)) / {k})) + 0.0 END, 12) AS mashDistance, commonHashes, totalHashes FROM z)"""


_MERGE = """,
a AS (SELECT * FROM r WHERE sample = 'en'), b AS (SELECT * FROM r WHERE sample = 'fr'),
m AS (SELECT coalesce(a.h, b.h) AS h, coalesce(a.kmer, b.kmer) AS kmer, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(a.extra, 0) + coalesce(b.extra, 0) AS extra FROM a FULL JOIN b ON a.h = b.h),
k AS (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM m WHERE h <= least((SELECT max(h) FROM a), (SELECT max(h) FROM b)))
SELECT CAST(h AS VARCHAR) AS hash, kmer, n AS "count", extra AS extra_count FROM k"""
_SINGLE = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_CARD = "CAST(CAST(least(floor(CAST(CAST(CAST(CAST(count(*) - 1 AS FLOAT) AS DOUBLE) / CAST(CAST(CAST(CAST(max(h) AS FLOAT) AS DOUBLE) / 18446744073709551616.0 AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE)), 18446744073709549568.0) AS UHUGEINT) AS VARCHAR)"


def _pipeline() -> str:
    f = FILTERS
    passed = f"SELECT * FROM r WHERE n < 16 OR least(extra, n - extra) / CAST(n AS DOUBLE) >= {f.strand_filter}"
    return _base(LONG, "source") + f",\nsf AS ({passed})" + _DENSE.format(src="sf", level=f.err_filter) + f"\n{_ROWS} FROM sf JOIN th USING (sample) WHERE n >= threshold AND n BETWEEN {f.abun_low} AND {f.abun_high}"


_L, _S, _LANG, _DOC = _base(LONG, "source"), _base(SHORT, "source"), _base(LONG, "lang"), _base(SHORT, "doc_id")

_ALL = "'all'"
_LETTERS = "SELECT doc_id, source, {} AS seq FROM documents".format(_encoded())
_HEX = "hex(encode(coalesce(text, '')))"
_NORMAL = f"regexp_replace(regexp_replace(translate(upper({_HEX} || ' u.~' || chr(10) || lower({_HEX})), 'U.~', 'T--'), '\\s', '', 'g'), '[^ACGTN-]', 'N', 'g')"
_FILES = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(seq) AS BIGINT) AS n_bases, md5(seq) AS seq_md5, '{{}}' AS format FROM ({_LETTERS})"""
_FACTS = """SELECT row_number() OVER (ORDER BY sample) - 1 AS sketch_id, sample, seq_length, num_valid_kmers"""


def _search() -> str:
    """Documents' sketches as queries, sources' as references; of each document the best."""
    k = MASHED.kmer_length
    text = _hashed("doc_id", k).replace("CAST(doc_id AS VARCHAR) AS sample", "CAST(doc_id AS VARCHAR) || chr(9) || source AS sample")
    return f"""{text},
gd AS (SELECT split_part(sample, chr(9), 1) AS sample, hash FROM g QUALIFY row_number() OVER (PARTITION BY sample ORDER BY hash) <= {DOC_MASHED.kmers_to_sketch}),
gs AS (SELECT sample, hash FROM (SELECT DISTINCT split_part(sample, chr(9), 2) AS sample, hash FROM g) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY hash) <= {MASHED.kmers_to_sketch}),
qd AS (SELECT CAST(doc_id AS VARCHAR) AS q, count(hash) AS n, max(hash) AS m FROM documents LEFT JOIN gd ON gd.sample = CAST(doc_id AS VARCHAR) GROUP BY 1),
rs AS (SELECT sample AS ref, max(hash) AS m FROM gs GROUP BY 1),
pr AS (SELECT q, ref, least(qd.m, rs.m) AS m, n FROM qd, rs),
cm AS (SELECT gd.sample AS q, gs.sample AS ref, count(*) AS c FROM gd JOIN gs USING (hash) GROUP BY ALL),
qi AS (SELECT pr.q, pr.ref, count(*) AS i FROM pr JOIN gd ON gd.sample = pr.q AND gd.hash <= pr.m WHERE n > 0 GROUP BY ALL),
rj AS (SELECT pr.q, pr.ref, count(*) AS j FROM pr JOIN gs ON gs.sample = pr.ref AND gs.hash <= pr.m WHERE n > 0 GROUP BY ALL),
y AS (SELECT q AS query, ref AS reference, coalesce(c, 0) AS c, coalesce(i, 0) AS i, coalesce(j, 0) AS j FROM pr LEFT JOIN cm USING (q, ref) LEFT JOIN qi USING (q, ref) LEFT JOIN rj USING (q, ref))
SELECT query, reference, CASE WHEN j = 0 THEN 0.0 ELSE CAST(c AS DOUBLE) / j END AS containment, CASE WHEN i - c + j = 0 THEN 1.0 ELSE CAST(c AS DOUBLE) / (i - c + j) END AS jaccard
FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY containment DESC, reference) = 1"""


def _file_oracles(totals: str) -> dict[str, str]:
    """Of the queries through files, collections and the command line."""
    small = lambda n: replace(MASHED, kmers_to_sketch=n, final_size=n)
    rows = f"{_ROWS} FROM r"
    low, high, strand = KEPT.abun_low, KEPT.abun_high, KEPT.strand_filter
    kept = f"(n BETWEEN {low} AND {high} AND (n < 16 OR least(extra, n - extra) / CAST(n AS DOUBLE) >= {strand}))"
    dense = _DENSE.format(src="r", level=0.0)
    return {
        "fasta_scan": _FILES.format("fasta"),
        "fastq_scan": _FILES.format("fastq") + " WHERE length(seq) > 0",
        "small_files": _FILES.format("fasta"),
        "normalised": f"SELECT doc_id, md5(s) AS seq_md5, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS rc_md5 FROM (SELECT doc_id, {_NORMAL} AS s FROM documents)",
        "native_files": f"{_S}\n{rows}",
        "json_files": f'{_S}\nSELECT sample, CAST(h AS VARCHAR) AS hash, kmer, n AS "count" FROM r',
        "mash_files": f'{_smallest("source", small(300))}\nSELECT sample, CAST(h AS VARCHAR) AS hash, n AS "count" FROM r',
        "sketch_facts": f"{_FACTS}, false AS filter_on, CAST(1 AS BIGINT) AS abun_low, CAST({MASHED.kmers_to_sketch} AS BIGINT) AS kmers_to_sketch, CAST({MASHED.kmer_length} AS BIGINT) AS kmer_length FROM ({totals})",
        "trimmed": f"{_smallest('source', small(TRIMMED.final_size))}\n{rows}",
        "filtered_sketches": f"{_S}\n{rows} WHERE {kept}",
        "reads_filter": f"{_S}\n{rows} WHERE right(sample, 1) NOT IN ('0', '2', '4', '6', '8') OR {kept}",
        "table_rows": f"{_smallest('source', MASHED)}\n{rows}",
        "collection_edit": """
WITH s AS (SELECT DISTINCT source AS sample FROM documents), f AS (SELECT min(sample) AS sample FROM s WHERE sample <> 'src3'),
a AS (SELECT sample, 0 AS part FROM s WHERE sample <> 'src3' AND sample <> (SELECT sample FROM f) UNION ALL SELECT sample, 1 FROM s WHERE sample IN ('src3', 'src5'))
SELECT sample, CAST(row_number() OVER (ORDER BY part, sample) AS INTEGER) AS place FROM a""",
        "cli_dist": _smallest("source", small(500)) + _distances(k=MASHED.kmer_length) + "\nSELECT * FROM x",
        "cli_hist": f"{_smallest('source', small(500))}{dense}\nSELECT sample, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS hist FROM h GROUP BY 1",
        "index_rows": f"{_smallest('source', MASHED)}\n{rows}",
        "index_search": _search(),
        "mixed_load": f"""{_smallest('source', small(300))}
{rows} UNION ALL SELECT 'file ' || sample, CAST(h AS VARCHAR), kmer, n, extra FROM r WHERE sample = (SELECT min(sample) FROM r)""",
    }


ORACLES = {
    "allcounts_k4": f"{_S}\n{_ROWS} FROM r",
    "hist": f"{_L}\nSELECT sample, n AS depth, count(*) AS n FROM r GROUP BY ALL",
    "dense_hist": f"{_DOC}{_DENSE.format(src='r', level=0.0)}\nSELECT sample, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS hist FROM h GROUP BY 1",
    "info_stats": f"""{_L}
SELECT sample, {_CARD} AS cardinality, {_SINGLE.format('sum(n) / CAST(count(*) AS DOUBLE)')} AS depth,
  {_SINGLE.format(f"100.0 * CAST(sum(n * length(regexp_replace(kmer, '[^GgCc]', '', 'g'))) AS DOUBLE) / CAST(sum(n) * {LONG} AS DOUBLE)")} AS gc FROM r GROUP BY 1""",
    "cardinality": f"{_DOC}\nSELECT sample, {_CARD} AS cardinality FROM r GROUP BY 1",
    "filter_abundance": f"{_L}\n{_ROWS} FROM r WHERE n BETWEEN 5 AND 50",
    "filter_strands": f"{_L}\n{_ROWS} FROM r WHERE n < 16 OR least(extra, n - extra) / CAST(n AS DOUBLE) >= 0.1",
    "guess_threshold": f"{_L}{_DENSE.format(src='r', level=0.05)}\nSELECT sample, threshold FROM th",
    "filter_pipeline": _pipeline(),
    "raw_distance": _L + _distances("a.sample = 'src0'") + "\nSELECT * FROM x",
    "old_distance": _L + _distances("a.sample = 'src0'", old=True) + "\nSELECT * FROM x",
    "pairwise_distance": _L + _distances() + "\nSELECT * FROM x",
    "max_dist": _L + _distances() + "\nSELECT * FROM x WHERE mashDistance <= 0.04",
    "query_by_name": _L + _distances("a.sample IN ('src3', 'src7')") + "\nSELECT * FROM x",
    "best_match": _L + _distances() + "\nSELECT query, reference, containment, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY containment DESC, reference) AS rn FROM x) WHERE rn = 1",
    "filter_to_matches": _L + _distances("a.sample = 'src0'") + f"\n{_ROWS} FROM r WHERE sample IN (SELECT reference FROM x WHERE containment >= 0.8)",
    "filter_to_names": f"{_L}\n{_ROWS} FROM r WHERE sample IN ('src1', 'src2')",
    "merge_sized": _LANG + _MERGE + " WHERE rn <= 1000",
    "merge_scaled": _LANG + _MERGE + f" WHERE h <= {max_hash(SMALL_SCALE)}",
    "merge_all": _LANG + _MERGE,
    "merge_sources": _L + """,
m AS (SELECT h, min(kmer) AS kmer, CAST(sum(n) AS BIGINT) AS n, CAST(sum(extra) AS BIGINT) AS extra FROM r GROUP BY 1),
x AS (SELECT max(h) AS m FROM r GROUP BY sample)
SELECT CAST(h AS VARCHAR) AS hash, kmer, n AS "count", extra AS extra_count FROM m WHERE h <= (SELECT min(m) FROM x) QUALIFY row_number() OVER (ORDER BY h) <= 2000""",
    "compare_counts": f"""{_LANG},
a AS (SELECT * FROM r WHERE sample = 'en'), b AS (SELECT * FROM r WHERE sample = 'fr'),
t AS (SELECT least((SELECT max(h) FROM a), (SELECT max(h) FROM b)) AS m),
j AS (SELECT CAST(a.n AS DOUBLE) AS qc, b.n AS rc FROM a JOIN b USING (h)),
u AS (SELECT *, qc - (SELECT avg(qc) FROM j) AS e FROM j),
v AS (SELECT count(*) AS common, CAST(sum(rc) AS BIGINT) AS ref_count, CAST(sum(qc) AS BIGINT) AS query_count, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM u)
SELECT common, (SELECT count(*) FROM b, t WHERE h <= m) AS ref_pos, (SELECT count(*) FROM a, t WHERE h <= m) AS query_pos, ref_count, query_count,
  round(m2, 4) AS var, round(m3 / (m2 * sqrt(m2)), 4) AS skew, round(m4 / (m2 * m2) - 3, 4) AS kurt FROM v""",
    "compare_matrix": f"""{_S},
p0 AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS ref_pos FROM r WHERE sample = 'src0'),
n0 AS (SELECT DISTINCT sample FROM r)
SELECT n0.sample, ref_pos, coalesce(r.n, 0) AS "count" FROM n0 CROSS JOIN p0 LEFT JOIN r ON r.sample = n0.sample AND r.h = p0.h""",
    "sparse_matrix": f"""{_smallest('source', MASHED)},
p0 AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS ref_pos FROM r WHERE sample = 'src0')
SELECT sample, ref_pos, n AS "count" FROM r JOIN p0 USING (h)""",
    "kmer_hash": f"{_smallest(_ALL, MASHED)}\n{_ROWS} FROM r",
    "mash_sketch": f"{_smallest('source', MASHED)}\n{_ROWS} FROM r",
    "mash_sketch_docs": f"{_smallest('doc_id', DOC_MASHED)}\n{_ROWS} FROM r",
    "scaled_sketch": f"{_smallest('source', SCALING)}\n{_ROWS} FROM r",
    "totals": f"""
SELECT CAST(source AS VARCHAR) AS sample, CAST(sum(4 * octet_length(encode(coalesce(text, '')))) AS BIGINT) AS seq_length,
  CAST(sum(greatest(0, 4 * octet_length(encode(coalesce(text, ''))) - {MASHED.kmer_length - 1})) AS BIGINT) AS num_valid_kmers FROM documents GROUP BY 1""",
    "mash_pairwise": _smallest("source", MASHED) + _distances(k=MASHED.kmer_length) + "\nSELECT * FROM x",
    "scaled_distance": _smallest("source", SCALING) + _distances(k=SCALING.kmer_length, scale=SCALING.scale) + "\nSELECT * FROM x",
    "set_counts": _base(SHORT, "lang") + """\nSELECT CAST(h AS VARCHAR) AS hash, kmer, n // 1000 AS "count", extra AS extra_count FROM r WHERE sample = 'en' AND n // 1000 > 0""",
}
ORACLES |= _file_oracles(ORACLES["totals"])
