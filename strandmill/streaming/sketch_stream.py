"""Sketches over unbounded input: Structured Streaming keeps a sketch of each sample in its state.

The state of a sample is its sketch so far and no more: the smallest hashes, as many as are sketched, and with a
scale all up to its limit. A hash that falls out lies above as many smaller ones as the sketch has, and these only
become more, so it never comes back and the counts of what stays are exact. After each micro-batch the
samples that it touched hand on their sketches. The state lives in RocksDB, below the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import SketchError
from ..operators.sketching import _OUT, _samples, _stage
from ..params import ALL, SCALED, U32, SketchParams

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def added(kept: pd.DataFrame | None, new: pd.DataFrame, params: SketchParams) -> pd.DataFrame:
    """A sketch's rows (hash as an unsigned number, kmer, count, extra_count) with more of them, cut to what the sketch keeps."""
    both = new if kept is None else pd.concat([kept, new])
    rows = both.groupby("hash", sort=True).agg(kmer=("kmer", "min"), count=("count", "sum"), extra_count=("extra_count", "sum")).reset_index()
    below = int(np.searchsorted(rows["hash"].to_numpy(), np.uint64(params.limit), side="right")) if params.scheme == SCALED else 0
    rows = rows.iloc[: max(params.kmers_to_sketch, below)]
    return rows.assign(count=rows["count"].clip(upper=U32), extra_count=rows["extra_count"].clip(upper=U32))


class Sketcher(StatefulProcessor):
    """One value a sample: its hashes, counts and reversed counts as packed words, and its k-mers in one text."""

    def __init__(self, params: SketchParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "hash binary, kmers string, count binary, extra binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        if self.kept.exists():
            hashes, kmers, count, extra = self.kept.get()
            held = pd.DataFrame({"hash": np.frombuffer(hashes, np.uint64), "kmer": kmers.split(" ") if kmers else [], "count": np.frombuffer(count, np.int64), "extra_count": np.frombuffer(extra, np.int64)})
        for part in rows:
            held = added(held, part.assign(hash=part["hash"].to_numpy(np.int64).view(np.uint64))[["hash", "kmer", "count", "extra_count"]], self.params)
        if held is None:
            return
        words = [np.ascontiguousarray(held[c].to_numpy()).tobytes() for c in ("hash", "count", "extra_count")]
        self.kept.update((words[0], " ".join(held["kmer"]), words[1], words[2]))
        if len(held):
            yield held.assign(sample=key[0], hash=held["hash"].to_numpy(np.uint64).view(np.int64))[["sample", "hash", "kmer", "count", "extra_count"]]

    def close(self) -> None:
        pass


def streaming_sketches(sequences: DataFrame, params: SketchParams) -> DataFrame:
    """sample, hash, kmer, count, extra_count of a streaming DataFrame of sequences, in update mode: after each micro-batch the
    whole sketches of the samples that it has. The session's state store must be RocksDB, as sketch_stream() sets it."""
    if params.scheme == ALL:
        raise SketchError("complete sketches are counted in batches")
    # the tasks' own bound holds here, too
    raw = _samples(sequences).mapInArrow(_stage(params), _OUT)
    return raw.groupBy("sample").transformWithStateInPandas(statefulProcessor=Sketcher(params), outputStructType=_OUT, outputMode="Update", timeMode="None")


def sketch_stream(sequences: DataFrame, params: SketchParams, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a query that hands the sketches that changed, whole, as minmers by sample, to sink after each micro-batch."""
    spark = sequences.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        made = streaming_sketches(sequences, params)
        return made.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(sink).start()
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)
