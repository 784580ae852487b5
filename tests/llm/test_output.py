import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strandmill.llm import mph, packing, pieces, token_shards
from strandmill.llm._parts import Parts
from strandmill.llm._work import new_path

from .conftest import TEXTS

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 3000])
def test_perfect_hash(n):
    rng = random.Random(n)
    keys = list({rng.getrandbits(64) - (1 << 63) for _ in range(n)}) if n > 5 else list(range(n))
    index = mph.Index(mph.build(keys, range(n), [k % 7 for k in keys]))
    assert len(index.offsets) == n
    for i, k in enumerate(keys):
        assert index.find(k) == (i, k % 7)
    assert sum(index.find(k) is not None for k in range(10**6, 10**6 + 200) if k not in set(keys)) == 0


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library():
    rng = random.Random(6)
    some = list("ab1.,!?'\n  ²é日\t\r") + ["'s", "'ll", "<|", " \n", " ", "_", "-", "<|endoftext|>", "\x1c", "\x85", "\xa0", "Ġ", "word", "\u2028"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "a  b", "x" * 5000]
    assert encoded(token_shards.Encoder(BPE, 2), texts) == whole_ids(texts)


def encoded(encoder, texts):
    out, row = [[] for _ in texts], 0
    for ids, per, whole in encoder.encode(pa.array(texts, pa.string())):
        at = 0
        for i, n in enumerate(per.tolist()):
            out[row + i] += ids[at : at + n].tolist()
            at += n
        assert at == len(ids)
        row += len(per) - (not whole)
    assert row == len(texts)
    return out


def test_encoder_takes_texts_in_steps_and_forgets(monkeypatch):
    monkeypatch.setattr(token_shards, "_STEP", 100)
    monkeypatch.setattr(token_shards, "_KNOWN", 20)
    texts = ["ab cd. " * 90, "", "x", "abc " * 70 + " " + "d e " * 50, "a" * 900, "ab, cd e" * 60, "it's <|endoftext|> " * 40, "\u2003 b" * 50, " " * 300, "\n" * 250 + "x" * 32 + "x" * 33]
    assert encoded(token_shards.Encoder(BPE, 2), texts) == whole_ids(texts)


def test_parts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\0c") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))).encode() for _ in range(5000)]
    data = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    size = np.array([len(t) for t in texts])
    parts, known = Parts(16), {}
    for at in range(0, 5000, 500):
        part = slice(at, at + 500)
        n = parts.n
        number, new = parts.number(data, (np.cumsum(size) - size)[part], size[part])
        assert number[new].tolist() == list(range(n, parts.n))
        for t, k in zip(texts[part], number.tolist(), strict=True):
            assert known.setdefault(t, k) == k
    assert len(known) == parts.n == len(set(known.values()))


def test_shards(spark, edge, empty):
    path = new_path(spark, "t")
    token_shards.write(edge, path, BPE)
    rows = sorted([(i, t or "") for i, t in TEXTS if i is not None])
    ids = [x + [0] for x in whole_ids([t for _, t in rows])]
    starts = np.cumsum([0] + [len(x) for x in ids]).tolist()
    want = [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids, strict=False)]
    got = [tuple(r) for r in token_shards.describe(spark, path).orderBy("key", "start").collect()]
    assert got == want
    asked = spark.createDataFrame([(1,), (9,), (12345,), (None,), (1,), (-5,)], "doc_id long")
    found = {r["key"]: r["ids"] for r in token_shards.fetch(spark, path, asked).collect()}
    assert found == {1: ids[0], 9: next(x for (i, _), x in zip(rows, ids, strict=True) if i == 9)}
    path = new_path(spark, "e")
    token_shards.write(empty, path, BPE)
    assert token_shards.describe(spark, path).count() == 0


@pytest.mark.parametrize("end", [0, 11])
def test_shards_of_repeated_ids(spark, end):
    """Ids 0 ("!") and the end id within texts; pages and shards of a few documents."""
    rng = random.Random(4)
    rows = [(rng.randrange(40), "".join(rng.choice(["!", " b", "x ", ",", "a"]) for _ in range(rng.randrange(9)))) for _ in range(400)]
    path = new_path(spark, "r")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    token_shards.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, BPE, end_id=end, page=5, shard_docs=20)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert token_shards._indices(spark, path).count() > 8
    ids = [x + [end] for x in whole_ids([t for _, t in rows])]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    got = token_shards.describe(spark, path).orderBy("start").collect()
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["key"] for r in got] == sorted(i for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    texts = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        texts[i].append(x)
    found = token_shards.fetch(spark, path, spark.createDataFrame([(i,) for i in range(-3, 50)], "doc_id long")).collect()
    assert {r["key"] for r in found} == set(texts) and all(r["ids"] in texts[r["key"]] for r in found)


def test_shards_know_their_width(spark):
    path = new_path(spark, "w")
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(20)], "doc_id long, text string")
    token_shards.write(docs, path, BPE, width=4, end_id=70_000, shard_docs=4)
    want = {i: [*x, 70_000] for i, x in enumerate(whole_ids([f"text {i} of some words" for i in range(20)]))}
    assert {r["key"]: r["ids"] for r in token_shards.fetch(spark, path, docs).collect()} == want
    got = {r["key"]: r["ids_crc32"] for r in token_shards.describe(spark, path).collect()}
    assert got == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
    assert {(r["width"], r["end_id"]) for r in token_shards._manifest(spark, path).collect()} == {(4, 70_000)}
    with pytest.raises(Exception, match="need more than 2 bytes"):
        token_shards.write(docs, new_path(spark, "w"), BPE, end_id=70_000)


def test_shards_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    start, want = 0, []
    for (i, _), x in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        want.append((i, start, len(x) + 1, zlib.crc32(np.array(x + [0], "<u4").tobytes())))
        start += len(x) + 1
    got = __spark_entry__.queries()["op6_token_shards"](spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_pieces_are_lossless(spark, edge, empty):
    s = pieces.Sampler.get(PIECES, 1.0)
    rng = random.Random(7)
    some = list("ab1.,!?'\n  ²é日\t\r▁") + ["▁▁", "word", "  ", "\x00", "🙂"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["ab" * 20_000]
    for t, x in zip(texts, s.sample(list(range(len(texts))), texts, 1), strict=True):
        assert s.decode(x.tolist()) == t
    got = pieces.sample_pieces(edge, PIECES, ids=True)
    assert got.count() == len(TEXTS)
    back = pieces.decode_pieces(got, PIECES)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in TEXTS)
    assert pieces.sample_pieces(empty, PIECES).count() == 0


def test_plain_pieces(spark, edge, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(edge, PIECES)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((i, tuple(sp.encode(t or ""))) for i, t in TEXTS)
    back = pieces.decode_pieces(got, PIECES)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in TEXTS)
    assert pieces.encode_pieces(empty, PIECES).count() == 0


def test_pieces_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, pieces.sample_pieces(docs.coalesce(1), PIECES).collect()))
    many = sorted(map(tuple, pieces.sample_pieces(docs.repartition(9).orderBy(F.rand(1)), PIECES).collect()))
    assert one == many
    other = sorted(map(tuple, pieces.sample_pieces(docs, PIECES, seed=1).collect()))
    assert sum(a[2] != b[2] for a, b in zip(one, other, strict=True)) > 0.9 * len(one)


def test_pieces_take_texts_in_steps_and_forget(monkeypatch):
    texts = ["ab cd, " * 90, "", "x", "abc " * 70 + "\n" + "d  e " * 50, "a" * 900, " " * 400, "日本 " * 80, "é" * 300, "ab, cd e" * 60]
    keys = list(range(len(texts)))
    monkeypatch.setattr(pieces, "_STEP", 100)
    whole = pieces.Sampler(PIECES, 1.0).sample(keys, texts, 5)
    assert [pieces.Sampler(PIECES, 1.0).decode(x.tolist()) for x in whole] == texts
    monkeypatch.setattr(pieces, "_KNOWN", 3)
    again = pieces.Sampler(PIECES, 1.0).sample(keys[::-1], texts[::-1], 5)[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(whole, again, strict=True))


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 100_000, "=" * 100_000, " " * 100_000, "日本語" * 50_000, "Zm9vYmFy" * 20_000])
def test_pieces_of_long_unspaced_texts(text):
    s = pieces.Sampler.get(PIECES, 1.0)
    began = time.process_time()
    [got] = s.sample([1], [text], 1)
    assert s.decode(got.tolist()) == text
    assert time.process_time() - began < 20  # linear: place by place this took minutes


def test_long_runs_have_the_same_shares(monkeypatch):
    """The way of long runs against that of short ones."""
    text = ["the" * 15 + "=" * 20]
    one = pieces.Sampler(PIECES, 0.7)
    one.sample([1], text, 1)
    monkeypatch.setattr(pieces, "_RUN", 1)
    monkeypatch.setattr(pieces, "_DRAWS", 2)
    two = pieces.Sampler(PIECES, 0.7)
    two.sample([1], text, 1)
    n = one.upto.n
    assert n == two.upto.n > 60 and np.array_equal(one.piece.a[:n], two.piece.a[:n])
    assert np.abs(one.upto.a[:n].astype(float) - two.upto.a[:n]).max() < 16
    assert np.array_equal(one.sample([3], text, 2)[0], two.sample([3], text, 2)[0])


def test_pieces_follow_the_lattice():
    """Frequencies of whole segmentations against all of them enumerated."""
    s = pieces.Sampler.get(PIECES, 0.5)
    text = "then"
    marked, ways = "▁" + text, {}
    names = {p: i for i, p in enumerate(_names())}

    def walk(at, ids, weight):
        if at == len(marked):
            ways[tuple(ids)] = weight
        for end in range(at + 1, len(marked) + 1):
            i = names.get(marked[at:end])
            if i is not None and i > 258:
                walk(end, [*ids, i], weight * s.weight[i])

    walk(0, [], 1.0)
    n = 40_000
    seen = Counter(tuple(x.tolist()) for x in s.sample(list(range(n)), [text] * n, 3))
    total = sum(ways.values())
    assert set(seen) <= set(ways) and len(ways) > 8
    for way, w in ways.items():
        p = w / total
        assert abs(seen[way] / n - p) < 5 * (p / n) ** 0.5 + 1e-4


def _names():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def test_registered_pieces_query(spark):
    """Ids that spell every text, as many of them as a plain forward pass over the whole texts expects."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names, n = _names(), sp.get_piece_size()
    spelt = {i: bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace("▁", " ").encode() for i in range(n)}
    weight = {names[i]: 1 / (1 + min(-sp.get_score(i), n)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    longest = max(map(len, weight))
    weight |= {chr(0xDC00 + b): 1.0 for b in range(256)}  # bytes of characters without a piece

    def expected(text):
        line = "".join("▁" if c == " " else c if c in weight and c != "▁" else "".join(chr(0xDC00 + b) for b in c.encode()) for c in " " + text)
        log, mean, square = [0.0], [0.0], [0.0]  # of all ways to a place: log weight, pieces, pieces squared
        for end in range(1, len(line) + 1):
            ways = [(log[a] + math.log(w), a) for a in range(max(0, end - longest), end) if (w := weight.get(line[a:end]))]
            top = max(x for x, _ in ways)
            parts = [(math.exp(x - top), a) for x, a in ways]
            total = sum(x for x, _ in parts)
            log.append(top + math.log(total))
            mean.append(sum(x * (mean[a] + 1) for x, a in parts) / total)
            square.append(sum(x * (square[a] + 2 * mean[a] + 1) for x, a in parts) / total)
        return mean[-1], max(0.0, square[-1] - mean[-1] ** 2)

    path = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op7_sampled_pieces"](spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = {r["doc_id"]: r["ids"] for r in pieces.sample_pieces(docs, PIECES, ids=True).collect()}
    assert set(got) == set(ids) == set(texts)
    for i, t in texts.items():
        assert b"".join(spelt[x] for x in ids[i]) == (" " + t if t else "").encode()
        assert (got[i]["n_pieces"], got[i]["ids_crc32"]) == (len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
    facts = {i: expected(t) if t else (0, 0) for i, t in texts.items()}
    for i, (mean, spread) in facts.items():
        assert abs(got[i]["n_pieces"] - mean) <= 6 * spread**0.5 + 1
    off = sum(got[i]["n_pieces"] - mean for i, (mean, _) in facts.items())
    assert abs(off) <= 3 * sum(v for _, v in facts.values()) ** 0.5 + 1


def padding(hist, edges):
    return sum((min(e for e in edges if e >= n) - n) * c for n, c in hist.items())


def test_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(60):
        hist = {n: rng.randint(1, 9) for n in rng.sample(range(1, 40), rng.randint(1, 9))}
        k = rng.randint(1, 4)
        edges = packing.boundaries(hist, k)
        sizes = sorted(hist)
        best = min(padding(hist, [*c, sizes[-1]]) for r in range(min(k, len(sizes))) for c in itertools.combinations(sizes[:-1], r))
        assert len(edges) <= k and padding(hist, edges) == best
    assert packing.boundaries({}, 3) == []


def lengths(texts):
    return [len(x) + 1 for x in whole_ids([t or "" for t in texts])]


def check_packed(rows, got, plan):
    """rows: (id, number of ids). Brute force: windows, buckets and places in order."""
    all_windows = []
    for i, n in rows:
        for seg in range(max(1, -(-n // plan.max_len))):
            all_windows.append((i, seg, min(plan.max_len, n - seg * plan.max_len)))
    edges = packing.boundaries(Counter(max(1, w[2]) for w in all_windows), plan.buckets)
    by = defaultdict(list)
    for w in all_windows:
        by[min(e for e in edges if e >= w[2])].append(w)
    want = []
    for e, ws in by.items():
        per = max(1, plan.budget // e)
        ws.sort(key=lambda w: (w[0] is not None, w[0] or 0, w[1]))
        want += [(i, seg, seg * plan.max_len, n, e, at // per, at % per) for at, (i, seg, n) in enumerate(ws)]
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    return edges


def rebuilt(got):
    """The ids of every row from its windows: (id, ids) of each."""
    by = defaultdict(list)
    for r in got:
        by[r["row"]].append(r)
    out = []
    for ws in by.values():
        ws.sort(key=lambda r: r["seg"])
        assert [w["seg"] for w in ws] == list(range(len(ws))) and len({w["doc_id"] for w in ws}) == 1
        parts = [np.frombuffer(w["ids"], "<u2").tolist() for w in ws]
        assert [w["n_tokens"] for w in ws] == [len(p) for p in parts] and [w["first"] for w in ws] == [sum(map(len, parts[:i])) for i in range(len(parts))]
        out.append((ws[0]["doc_id"], tuple(sum(parts, []))))
    return Counter(out)


def expected(rows):
    return Counter((i, (*x, token_shards.END_ID)) for (i, _), x in zip(rows, whole_ids([t or "" for _, t in rows]), strict=True))


def test_packing(spark, edge, empty):
    plan = packing.Plan(50, 4, 200)
    rows = list(zip([i for i, _ in TEXTS], lengths([t for _, t in TEXTS]), strict=True))
    got = packing.pack(edge, BPE, plan=plan).collect()
    check_packed(rows, got, plan)
    assert rebuilt(got) == expected(TEXTS)  # null and repeated ids, and repeated rows
    with pytest.raises(Exception, match="more than 1 bytes"):
        packing.pack(edge, BPE, width=1).collect()
    check_packed([(i, len(t or "")) for i, t in TEXTS], packing.pack(edge, None, plan=plan, tokens=F.length(F.coalesce("text", F.lit("")))).collect(), plan)
    assert packing.pack(empty, BPE).count() == 0


def test_packing_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = list(zip([r["doc_id"] for r in rows], lengths([r["text"] for r in rows]), strict=True))
    check_packed(want, __spark_entry__.queries()["op10_packing"](spark, "/root/testdata/sf0.01").collect(), packing.Plan())


def test_packed_windows_hold_the_ids_of_the_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = new_path(spark, "p")
    token_shards.write(docs, path, BPE)
    held = Counter((r["key"], tuple(r["ids"])) for r in token_shards.fetch(spark, path, docs).collect())
    assert rebuilt(packing.pack(docs, BPE, plan=packing.Plan(100, 5, 1000)).collect()) == held


def test_windows_of_texts_that_are_encoded_in_steps(spark, monkeypatch):
    """Windows go on through the steps of a long text, wherever these end."""
    monkeypatch.setattr(token_shards, "_STEP", 50)
    rows = [(1, "ab cd " * 60), (2, "x"), (None, "the end of it " * 40), (3, ""), (4, "ab cd " * 60)]
    for size in (1, 7, 64, 10**6):
        run = packing._windowed(BPE, 2, size, token_shards.END_ID)
        batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows]), pa.array(range(5), pa.int64())], names=["id", "text", "row"])
        got = [packing_row(r) for b in run([batch]) for r in b.to_pylist()]
        assert rebuilt(got) == expected(rows)


def packing_row(r):
    return {**r, "doc_id": r["id"]}


def test_packing_spreads_equal_rows(spark):
    """Rows without ids, all alike: every range gets a share of them, and they fill whole batches."""
    plan = packing.Plan(100, 4, 1000)
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    parts = []
    real = packing.durable

    def seen(df, tag, *more):
        out = real(df, tag, *more)
        if tag == "dealt":
            parts.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    packing.durable = seen
    try:
        got = packing.pack(docs, BPE, plan=plan).collect()
    finally:
        packing.durable = real
    check_packed([(None, 3)] * 20_000, got, plan)
    assert len(parts) == 4 and max(parts) < 8_000


def test_pipeline(spark):
    """Stage by stage against brute force on what each stage really got."""
    from strandmill.llm import quality, secrets, simhash

    from .test_dedup import brute_lines, check_similar
    from .test_secrets import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, "s")
        stage(spark, steps[-1], sf).write.parquet(path)
        steps.append(spark.read.parquet(path))
        assert steps[-1].columns == docs.columns
    tables = [{r["doc_id"]: r.asDict() for r in s.collect()} for s in steps]

    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(tables[0])
    scores = model.score([tables[0][i]["text"] for i in ids])
    assert set(tables[1]) == {i for i, s in zip(ids, scores, strict=True) if s >= 0.5} and len(tables[1]) < len(ids)

    lines = {k[0]: k[3] for k in brute_lines([(i, r["text"]) for i, r in tables[1].items()])}
    assert {i: r["text"] for i, r in tables[2].items()} == lines
    assert all(r["n_chars"] == len(r["text"]) for r in tables[2].values())

    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(steps[2], shingle=corpus_pipeline.SHINGLE, similarity=corpus_pipeline.SIMILARITY).collect()}
    check_similar({i: r["text"] for i, r in tables[2].items()}, got)
    assert set(tables[3]) == set(got.values()) and len(tables[3]) < len(tables[2])

    assert {i: r["text"] for i, r in tables[4].items()} == {i: secrets.redact(r["text"], brute(r["text"])) for i, r in tables[3].items()}
    rows = list(zip(tables[4], lengths([r["text"] for r in tables[4].values()]), strict=True))
    check_packed(rows, corpus_pipeline.STAGES[-1][1](spark, steps[4], sf).collect(), packing.Plan())
    whole = corpus_pipeline.run(spark, sf).collect()
    check_packed(rows, whole, packing.Plan())
    assert rebuilt(whole) == expected([(i, r["text"]) for i, r in tables[4].items()])


def test_pipeline_stages_take_edges(spark, edge, empty):
    """Nulls, empty and very long texts, repeated rows, empty tables, and columns named like those inside the operators."""
    from strandmill.llm import secrets

    from .test_dedup import brute_lines

    sf = "/root/testdata/sf0.001"
    names = ["_score", "_text", "_kept", "_n_lines", "_row", "keep", "bitmap", "label", "_id"]
    extra = edge.withColumn("n_chars", F.length("text").cast("long"))
    for n in names:
        extra = extra.withColumn(n, F.lit(n))
    odd = ["a.b", "c`d", "e f", "", "g.h`i j", "*"]
    nested = F.struct(F.lit(1).alias("x y"), F.struct(F.lit("z").alias("p.q`r")).alias("s t"), F.array(F.struct(F.lit(2.0).alias("u v"))).alias("w:"))
    extra = extra.select("*", *[F.lit(f"odd {n}").alias(n) for n in odd], nested.alias("n.e`s t"))
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, extra.limit(0), sf).count() == 0 and stage(spark, empty, sf).count() == 0
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in extra.columns if c not in ("text", "n_chars")]
    for name in ("quality", "lines", "near_duplicates", "secrets"):
        out = stages[name](spark, extra, sf)
        seen = lambda d: {repr(r) for r in d.select(rest).collect()}
        assert out.columns == extra.columns and [f.dataType for f in out.schema] == [f.dataType for f in extra.schema] and seen(out) <= seen(extra), name
    all_rows = Counter((i, t) for i, t in TEXTS)
    rows = lambda name: Counter((r["doc_id"], r["text"]) for r in stages[name](spark, extra, sf).collect())
    good = rows("quality")
    assert good and not good - all_rows and all(n == all_rows[k] for k, n in good.items())
    kept = {k[0]: k[3] for k in brute_lines([(i, t) for i, t in TEXTS if i is not None])}
    assert rows("lines") == Counter((i, (t or "") if i is None else kept[i]) for i, t in TEXTS)
    # 4, 5 and 6 have no words; 8 repeats the text of 7
    assert rows("near_duplicates") == Counter((i, t) for i, t in TEXTS if i not in (5, 6, 8))
    assert rows("secrets") == Counter((i, None if t is None else secrets.redact(t, secrets.spans(t))) for i, t in TEXTS)
    check_packed(list(zip([i for i, _ in TEXTS], lengths([t for _, t in TEXTS]), strict=True)), (packed := stages["packing"](spark, extra, sf).collect()), packing.Plan())
    assert rebuilt(packed) == expected(TEXTS)
