import random

import pandas as pd
import pytest

from strandmill.operators import sketching
from strandmill.params import MASH, SCALED, SketchParams
from strandmill.streaming.sketch_stream import added, sketch_stream

from .test_sketching import got_rows, sequences


@pytest.mark.parametrize("p", [SketchParams(MASH, 20, kmer_length=7), SketchParams(SCALED, 0, kmer_length=7, scale=0.1), SketchParams(SCALED, 10, kmer_length=7, scale=0.1)])
def test_stream_equals_batch(spark, tmp_path, p):
    schema = "sample string, record_no long, seq string"
    rows = sequences(4)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    last, batches = {}, []

    def sink(df, n):
        got = df.toPandas()
        batches.append(n)
        last.update({s: part for s, part in got.groupby("sample")})

    query = sketch_stream(stream, p, sink, f"{tmp_path}/state", availableNow=True)
    query.awaitTermination(240)
    assert query.exception() is None and batches == [0, 1, 2]
    want = got_rows(sketching.minmers(spark.createDataFrame(rows, schema), p))
    assert got_rows(spark.createDataFrame(pd.concat(last.values()))) == want
    # one value a sample, whatever came by
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({r[0] for r in rows})


def test_what_is_kept_has_a_bound():
    rng = random.Random(2)
    for p in (SketchParams(MASH, 15), SketchParams(SCALED, 5, scale=0.2), SketchParams(SCALED, 0, scale=0.2)):
        kept, counts = None, {}
        few = [rng.getrandbits(64) for _ in range(200)]
        for _ in range(40):
            new = [(h, "A", rng.randint(1, 5), 1) for h in rng.choices(few, k=30)]
            for h, _, n, _ in new:
                counts[h] = counts.get(h, 0) + n
            kept = added(kept, pd.DataFrame(new, columns=["hash", "kmer", "count", "extra_count"]).astype({"hash": "uint64"}), p)
            low = [h for i, h in enumerate(sorted(counts)) if i < p.kmers_to_sketch or p.scheme == SCALED and h <= p.limit]
            assert list(zip(kept["hash"].tolist(), kept["count"].tolist(), strict=True)) == [(h, counts[h]) for h in low]
