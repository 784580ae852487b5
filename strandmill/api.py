"""Sketching whole files, and collections of sketches as values.

A Collection is immutable: its two tables are lazy, and what changes it returns another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import SketchError
from .operators import combine, filters, sketching, stats
from .operators import distance as D
from .params import ALL, FILTER_PARAMS, MASH, MINMERS, SCALED, SKETCH_PARAMS, SKETCHES, U32, FilterParams, SketchParams, common_params, signed
from .sources import formats, index, tables
from .sources import sequences as S

#: What to call a scheme: (sequences, params) -> sample, hash, kmer, count, extra_count.
SCHEMES = {MASH: sketching.minmers, SCALED: sketching.minmers, ALL: sketching.minmers}


def register_scheme(name: str, minmers) -> None:
    """Adds a scheme of your own; SketchParams of it need a subclass that admits the name."""
    SCHEMES[name] = minmers


def sketch_sequences(sequences: DataFrame, params: SketchParams = SketchParams(), filter_params: FilterParams = FilterParams(), check: bool = True) -> Collection:
    """Sketches of all samples in one job: count, filter, trim. Samples keep the order of their ordinal, then name.

    Filters that are neither on nor off follow each sample's format. check: run the job that finds strict sketches with
    too few k-mers; without it they stay short."""
    sequences = sequences if "ordinal" in sequences.columns else sequences.withColumn("ordinal", F.lit(0))
    sequences = sequences if "format" in sequences.columns else sequences.withColumn("format", F.lit(S.FASTA))
    sequences = sequences if "record_no" in sequences.columns else sequences.withColumn("record_no", F.lit(0))
    if SCHEMES[params.scheme] is sketching.minmers:  # one pass over the records gives all there is to know
        scan = tables.held(sketching.scanned(sequences, params))
        heads, rows = sketching.facts_of(scan, params), sketching.picked(sketching.counts_of(scan, params), params)
    else:
        heads = sequences.groupBy("sample").agg(F.min("ordinal").alias("ordinal"), F.min_by("format", F.struct("ordinal", "record_no")).alias("format"))
        heads = heads.join(sketching.totals(sequences, params), "sample", "left")
        rows = SCHEMES[params.scheme](sequences, params)
    if filter_params.filter_on is None:
        fastq = rows.join(heads.where(F.col("format") == S.FASTQ).select("sample"), "sample", "left_semi")
        fasta = rows.join(heads.where(F.col("format") == S.FASTQ).select("sample"), "sample", "left_anti")
        kept, found = filters.filter_counts(fastq, filter_params.resolved(True))
        kept = kept.unionByName(fasta)
        on = F.col("format") == S.FASTQ
    else:
        kept, found = filters.filter_counts(rows, filter_params)
        on = F.lit(filter_params.filter_on)
    kept = filters.final_trim(kept, params)
    if check:
        filters.check_full(heads, kept, params)
    low = F.lit(filter_params.abun_low).cast("bigint")
    if found is not None:  # the guess replaces a laxer bound
        heads = heads.join(found, "sample", "left")
        low = F.greatest(low, F.col("threshold"))
    applied = F.struct(on.alias("filter_on"), low.alias("abun_low"), F.lit(filter_params.abun_high).cast("bigint").alias("abun_high"), F.lit(filter_params.err_filter).alias("err_filter"), F.lit(filter_params.strand_filter).alias("strand_filter"))
    # ids in order of the files: as many rows as there are samples
    ids = heads.select("sample", F.row_number().over(Window.orderBy("ordinal", "sample")).alias("n")).select("sample", (F.col("n") - 1).cast("bigint").alias("sketch_id"))
    heads = heads.join(ids, "sample").select("sketch_id", F.col("sample").alias("name"), F.coalesce("seq_length", F.lit(0)).cast("bigint").alias("seq_length"), F.coalesce("num_valid_kmers", F.lit(0)).cast("bigint").alias("num_valid_kmers"), F.lit("").alias("comment"), applied.cast(FILTER_PARAMS).alias("filter_params"), _literal(params.row(), SKETCH_PARAMS).alias("sketch_params"))
    minmers = kept.join(ids, "sample").select("sketch_id", "hash", "kmer", F.col("count").cast("bigint").alias("count"), F.col("extra_count").cast("bigint").alias("extra_count"), F.lit(None).cast("binary").alias("label"))
    return Collection(heads, minmers)


def _literal(values: tuple, kind: str):
    names = [f.split(":")[0] for f in kind[7:-1].split(",")]
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)]).cast(kind)


def sketch_files(spark: SparkSession, paths: list[str], params: SketchParams = SketchParams(), filter_params: FilterParams = FilterParams(), check: bool = True) -> Collection:
    """Sketches of sequence files, in their order, all in one job."""
    return sketch_sequences(S.read_sequences(spark, paths), params, filter_params, check)


def sketch_file(spark: SparkSession, path: str, n_hashes: int = 1000, final_size: int | None = None, kmer_length: int = 21, filter: bool = True, seed: int = 0, no_strict: bool = False) -> Sketch:
    """One file's mash sketch; filter drops likely errors (level 1) and k-mers of one strand (0.1)."""
    params = SketchParams(MASH, n_hashes, final_size, no_strict, kmer_length, seed)
    return Collection.single(sketch_files(spark, [path], params, FilterParams(filter, None, None, 1.0, 0.1)))


def load(spark: SparkSession, paths: list[str], params: SketchParams | None = None, filter_params: FilterParams = FilterParams(), given: tuple[str, ...] = (), check: bool = True, compat: bool = False) -> Collection:
    """Sketch files first, then sequence files sketched with the parameters of the first sketch, or with params.

    given: fields of params that were asked for by name and so must agree with the sketch files. Filters that are on
    apply to read sketches, too; compat notes them without applying them."""
    ready, raw = [p for p in paths if formats.is_sketch(p)], [p for p in paths if not formats.is_sketch(p)]
    out = Collection.open(spark, ready) if ready else None
    if out is not None:
        common = common_params(out.all_params())
        params = inherit(params or SketchParams(), common, given) if raw else common
        if filter_params.filter_on:
            out = out.filtered(filter_params, compat)
    if raw:
        new = sketch_files(spark, raw, params or SketchParams(), filter_params, check)
        out = new if out is None else out.add(new)
    if out is None:
        raise SketchError("no files")
    return out


def inherit(params: SketchParams, first: SketchParams, given: tuple[str, ...] = ()) -> SketchParams:
    """params, with what wasn't asked for by name taken from the first sketch file; what was must agree with it."""
    if "scheme" in given and params.scheme != first.scheme:
        raise SketchError(f"the sketch files hold {first.scheme} sketches, not {params.scheme}")
    out = replace(params, scheme=first.scheme, scale=params.scale if "scale" in given else first.scale)
    for name in ("kmer_length", "hash_seed"):
        if name in given and getattr(params, name) != getattr(first, name):
            raise SketchError(f"the sketch files have {name} {getattr(first, name)}, not {getattr(params, name)}")
        out = replace(out, **{name: getattr(first, name)})
    if "scale" in given and first.scale is not None and params.scale != first.scale:
        raise SketchError(f"the sketch files have scale {first.scale}, not {params.scale}")
    if "final_size" not in given:
        # what is sketched before filters stays as it was, so that they leave enough
        out = replace(out, final_size=first.final_size, kmers_to_sketch=max(out.kmers_to_sketch, first.final_size))
    return out


class Collection:
    """Sketches in order: `sketches` (a row each) and `minmers` (a row a hash)."""

    #: The files of an opened index: its rows are in place, and need no copy to be read again.
    stored: index.Index | None = None

    def __init__(self, sketches: DataFrame, minmers: DataFrame):
        self.sketches, self.minmers = sketches.select([c.split()[0] for c in _fields(SKETCHES)]), minmers.select([c.split()[0] for c in _fields(MINMERS)])

    @property
    def spark(self) -> SparkSession:
        return self.sketches.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str]) -> Collection:
        nested = tables.read_sketches(spark, paths)
        ids = nested.select("ordinal", "place").withColumn("sketch_id", (F.row_number().over(Window.orderBy("ordinal", "place")) - 1).cast("bigint"))
        return cls(*tables.split(nested.join(ids, ["ordinal", "place"])))

    @classmethod
    def from_sketches(cls, sketches: Iterable[Sketch]) -> Collection:
        plain = [s.data for s in sketches]
        if not plain:
            raise SketchError("no sketches")
        return cls.of(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), plain)

    @classmethod
    def of(cls, spark: SparkSession, plain: list[dict]) -> Collection:
        """From plain sketches on the driver."""
        heads = [(i, s["name"], s["seq_length"], s["num_valid_kmers"], s["comment"], s["filters"].row(), s["params"].row()) for i, s in enumerate(plain)]
        rows = [(i, signed(h), m, n, e, x) for i, s in enumerate(plain) for h, m, n, e, x in s["rows"]]
        return cls(spark.createDataFrame(heads, SKETCHES), spark.createDataFrame(rows, MINMERS))

    @staticmethod
    def single(c: Collection) -> Sketch:
        return c[0]

    def __len__(self) -> int:
        return self.sketches.count()

    def __repr__(self) -> str:
        return f"<Collection with {len(self)} sketches>"

    def names(self) -> list[str]:
        return [r["name"] for r in self.sketches.select("sketch_id", "name").orderBy("sketch_id").collect()]

    def all_params(self) -> list[SketchParams]:
        """Each different set of parameters, that of the first sketch first."""
        found = self.sketches.groupBy("sketch_params").agg(F.min("sketch_id").alias("at")).orderBy("at").collect()
        return [SketchParams.of(r["sketch_params"]) for r in found]

    def __iter__(self):
        return (Sketch(d) for d in tables.each(self.nested()))

    def _id(self, key: int | str) -> int:
        if isinstance(key, str):
            found = self.sketches.where(F.col("name") == key).agg(F.min("sketch_id")).first()[0]
            if found is None:
                raise KeyError(key)
            return found
        ids = self.sketches.select("sketch_id")
        down = key < 0
        found = ids.orderBy(F.col("sketch_id").desc() if down else "sketch_id").offset(-key - 1 if down else key).limit(1).collect()
        if not found:
            raise IndexError(f"no sketch {key}")
        return found[0][0]

    def __getitem__(self, key: int | str) -> Sketch:
        """By place, from the end if negative, or by name."""
        at = self._id(key)
        return Sketch(tables.plain(self._only(F.col("sketch_id") == at).nested())[0])

    def without(self, key: int | str) -> Collection:
        at = self._id(key)
        return self._only(F.col("sketch_id") != at)

    def __contains__(self, name) -> bool:
        return isinstance(name, str) and not self.sketches.where(F.col("name") == name).isEmpty()

    def _only(self, which) -> Collection:
        """which: a condition on sketch_id."""
        return Collection(self.sketches.where(which), self.minmers.where(which))

    def nested(self) -> DataFrame:
        return tables.nest(self.sketches, self.minmers)

    def save(self, path: str) -> None:
        """One file, by its ending: .bsk, .msh, .sk or .json."""
        if not formats.is_sketch(path):
            raise SketchError(f"{path} has no ending of a sketch file")
        tables.write_sketches(self.nested(), path)

    def add(self, other: Collection) -> Collection:
        """Both, the other one's after these."""
        start = (self.sketches.agg(F.max("sketch_id")).first()[0] or 0) + 1
        moved = lambda d: d.withColumn("sketch_id", F.col("sketch_id") + start)
        return Collection(self.sketches.unionByName(moved(other.sketches)), self.minmers.unionByName(moved(other.minmers)))

    def filtered(self, params: FilterParams, compat: bool = False) -> Collection:
        """Filters applied to sketches as they are; compat only notes them."""
        rows = self.minmers
        if not compat:
            rows, _ = filters.filter_counts(rows, params, "sketch_id")
        # one row of parameters a kind of filters
        kinds = [FilterParams.of(r[0]) for r in self.sketches.select("filter_params").distinct().collect()]
        new = F.col("filter_params")
        for k in kinds:
            new = F.when(F.col("filter_params").eqNullSafe(_literal(k.row(), FILTER_PARAMS)), _literal(k.tightened(params, compat).row(), FILTER_PARAMS)).otherwise(new)
        return Collection(self.sketches.withColumn("filter_params", new), rows)

    def profile(self) -> DataFrame:
        """sketch_id, name, n (hashes), top (the largest), same: equal for sketches that are equal in everything. One aggregation;
        rows add up in any order, to two sums of 64-bit hashes of all they hold."""
        of = ["hash", "kmer", "count", "extra_count", "label"]
        mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), *of, F.col("kmer").isNull(), F.col("label").isNull()).cast("decimal(38,0)"))
        rows = D.profiles(self.minmers, "sketch_id", mark(1).alias("m1"), mark(2).alias("m2"))
        whole = self.sketches.join(rows, "sketch_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        head = F.to_json(F.struct("name", "seq_length", "num_valid_kmers", "comment", "filter_params", "sketch_params", "n", "m1", "m2"), {"ignoreNullFields": "false"})
        return whole.select("sketch_id", "name", "n", "top", F.sha2(head, 256).alias("same"))

    def _measured(self, asked: Collection, max_dist: float = 1.0, old: bool = False, skip_equal: bool = True) -> DataFrame:
        """The distances of all sketches of asked to these, by sketch_id, with names qname and rname."""
        everything = self.all_params() + (asked.all_params() if asked is not self else [])
        params = common_params(everything)
        scales = {p.scale for p in everything} if params.scheme == SCALED else {None}
        if self.stored is not None:
            rows, heads = self.stored.minmers.select("sketch_id", "hash"), self.stored.profile
        else:
            rows, heads = (tables.held(x) for x in (self.minmers.select("sketch_id", "hash"), self.profile()))
        mine, theirs = (rows, heads) if asked is self else (tables.held(x) for x in (asked.minmers.select("sketch_id", "hash"), asked.profile()))
        side = lambda h, x, by: h.select(F.col("sketch_id").alias(by), F.col("name").alias(f"{x}name"), F.col("n").alias(f"{x}n"), F.col("top").alias(f"{x}t"), F.col("same").alias(f"{x}s"))
        return D.distances(
            mine.withColumnRenamed("sketch_id", "query"), rows.withColumnRenamed("sketch_id", "reference"), side(theirs, "q", "query"), side(heads, "r", "reference"),
            params.k, min(scales) if None not in scales else None, old, max_dist, _bits(params), F.col("qs") != F.col("rs") if skip_equal else None,
            None if self.stored is None else self.stored.places.withColumnRenamed("sketch_id", "reference"),
        )

    def distances(self, queries: Collection | None = None, names: list[str] | None = None, pairwise: bool = False, max_dist: float = 1.0, old: bool = False) -> DataFrame:
        """query, reference, containment, jaccard, mashDistance, commonHashes, totalHashes.

        Queries: those of another collection, the named ones, all (pairwise), or the first one. Equal sketches aren't
        compared. All sketches must go together."""
        asked = queries
        if asked is None:
            asked = self if pairwise else self._named(names) if names is not None else self._only(F.col("sketch_id") == self._id(0))
        out = self._measured(asked, max_dist, old)
        return out.select(F.col("qname").alias("query"), F.col("rname").alias("reference"), "containment", "jaccard", "mashDistance", "commonHashes", "totalHashes")

    def best_matches(self, queries: Collection) -> DataFrame:
        """query, reference (sketch_ids), containment, jaccard: of each sketch of queries the sketch here with the greatest
        containment; the first of several."""
        return D.best_match(self._measured(queries, skip_equal=False))

    def _named(self, names: list[str]) -> Collection:
        heads = self.sketches.where(F.col("name").isin(list(names)))
        return Collection(heads, self.minmers.join(heads.select("sketch_id"), "sketch_id", "left_semi"))

    def merged(self, size: int | None = None, scale: float | None = None, keep_tail: bool = False, name: str | None = None) -> Collection:
        """One sketch out of all, in one aggregation; their lengths and k-mers add up, the rest is the first one's. scale: by
        default the sketches' own."""
        params = common_params(self.all_params())
        rows = combine.merge_many(self.minmers, "sketch_id", self.sketches, size, params.scale if scale is None else scale, keep_tail)
        one = lambda c: F.min_by(c, "sketch_id").alias(c)
        head = self.sketches.agg(F.lit(0).cast("bigint").alias("sketch_id"), F.lit(name).alias("name") if name else one("name"), *[F.sum(c).alias(c) for c in ("seq_length", "num_valid_kmers")], *[one(c) for c in ("comment", "filter_params", "sketch_params")])
        return Collection(head, rows.withColumn("sketch_id", F.lit(0).cast("bigint")))

    def filter_to_names(self, names: list[str]) -> Collection:
        return self._named(names)

    def _containments(self, query: Sketch) -> DataFrame:
        """sketch_id, containment, jaccard of each sketch as the reference of one query."""
        return self._measured(Collection.of(self.spark, [query.data]), skip_equal=False).select(F.col("reference").alias("sketch_id"), "containment", "jaccard")

    def best_match(self, query: Sketch) -> tuple[int, Sketch]:
        """(place, sketch) with the greatest containment; the first of several."""
        got = self._containments(query).orderBy(F.col("containment").desc(), "sketch_id").limit(1).collect()
        if not got:
            raise SketchError("no sketches")
        at = got[0]["sketch_id"]
        return self.sketches.where(F.col("sketch_id") < at).count(), Sketch(tables.plain(self._only(F.col("sketch_id") == at).nested())[0])

    def filter_to_matches(self, query: Sketch, threshold: float) -> Collection:
        near = self._containments(query).where(F.col("containment") >= threshold).select("sketch_id")
        return Collection(self.sketches.join(near, "sketch_id", "left_semi"), self.minmers.join(near, "sketch_id", "left_semi"))

    def save_index(self, path: str, buckets: int | None = None) -> None:
        """The collection as tables bucketed by hash: the form to search many times."""
        params = common_params(self.all_params())
        index.write_index(self.sketches, self.minmers, self.profile(), path, _bits(params), buckets)

    @classmethod
    def open_index(cls, spark: SparkSession, path: str) -> Collection:
        """What save_index() wrote; its rows lie in buckets, and searches read them where they are."""
        found = index.open_index(spark, path)
        out = cls(found.sketches, found.minmers)
        out.stored = found
        return out

    def info(self) -> DataFrame:
        """sketch_id, name, seq_length, cardinality, depth, gc."""
        some = stats.info(self.minmers, "sketch_id")
        return self.sketches.select("sketch_id", "name", "seq_length").join(some, "sketch_id", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit(0).cast("decimal(20,0)")))

    def hist(self) -> DataFrame:
        """sketch_id, name, hist."""
        return self.sketches.select("sketch_id", "name").join(stats.dense_histogram(self.minmers, "sketch_id"), "sketch_id", "left").withColumn("hist", F.coalesce("hist", F.array().cast("array<bigint>")))


def _bits(params: SketchParams) -> int:
    """Binary digits of a hash; a complete sketch's are the k-mers themselves."""
    return 2 * params.k if params.scheme == ALL else 64


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


class Sketch:
    """One sketch on the driver; its size is bounded by its parameters."""

    def __init__(self, data: dict | str):
        self.data = data if isinstance(data, dict) else formats.sketch(data, [], SketchParams(no_strict=True))

    params = property(lambda self: self.data["params"])
    seq_length = property(lambda self: self.data["seq_length"])
    num_valid_kmers = property(lambda self: self.data["num_valid_kmers"])

    @property
    def name(self) -> str:
        return self.data["name"]

    @name.setter
    def name(self, value: str) -> None:
        self.data = self.data | {"name": value}

    @property
    def comment(self) -> str:
        return self.data["comment"]

    @comment.setter
    def comment(self, value: str) -> None:
        self.data = self.data | {"comment": value}

    def __len__(self) -> int:
        return len(self.data["rows"])

    def __repr__(self) -> str:
        return f'<Sketch "{self.name}">'

    def __eq__(self, other) -> bool:
        return isinstance(other, Sketch) and self.data == other.data

    __hash__ = None

    @property
    def hashes(self) -> list[tuple[int, str, int, int]]:
        """(hash, k-mer, count, extra count), ascending."""
        return [r[:4] for r in self.data["rows"]]

    @property
    def sketch_params(self) -> dict:
        p = self.params
        kind, bits, seed, scale = p.hash_info()
        return {"sketch_type": p.scheme, "kmer_length": p.k, "kmers_to_sketch": p.kmers_to_sketch, "final_size": p.final_size, "no_strict": p.no_strict, "hash_type": kind, "hash_bits": bits, "hash_seed": seed, "scale": scale}

    @property
    def counts(self) -> list[int]:
        return [r[2] for r in self.data["rows"]]

    @counts.setter
    def counts(self, values) -> None:
        values = [int(v) for v in values]
        if len(values) != len(self):
            raise SketchError(f"{len(self)} counts are needed, not {len(values)}")
        if any(v < 0 or v > U32 for v in values):
            raise SketchError("a count is out of range")
        self.data = self.data | {"rows": [(h, m, v, e, x) for (h, m, _, e, x), v in zip(self.data["rows"], values, strict=True) if v]}

    def copy(self) -> Sketch:
        return Sketch(dict(self.data) | {"rows": list(self.data["rows"])})

    def as_collection(self) -> Collection:
        return Collection.of(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), [self.data])

    def _rows(self) -> DataFrame:
        return self.as_collection().minmers.drop("sketch_id")

    def merge(self, other: Sketch, size: int | None = None, scale: float | None = None, keep_tail: bool = False) -> Sketch:
        """Both sketches' hashes with summed counts; checked before anything changes. scale: by default the sketch's own."""
        if bad := self.params.incompatible(other.params):
            raise SketchError(f"Sketch has {bad[0]} {bad[2]}, but the first one has {bad[1]}")
        rows = combine.merge(self._rows(), other._rows(), size, self.params.scale if scale is None else scale, keep_tail).collect()
        data = [(r["hash"] % (1 << 64), r["kmer"], r["count"], r["extra_count"], None if r["label"] is None else bytes(r["label"])) for r in rows]
        return Sketch(self.data | {"rows": sorted(data), "seq_length": self.seq_length + other.seq_length, "num_valid_kmers": self.num_valid_kmers + other.num_valid_kmers})

    def compare(self, other: Sketch, old: bool = False) -> tuple[float, float]:
        """(containment, jaccard) of other, the query, against this, the reference."""
        row = self.as_collection()._measured(other.as_collection(), old=old, skip_equal=False).first()
        return row["containment"], row["jaccard"]

    def compare_counts(self, other: Sketch) -> tuple:
        """(common, ref_pos, query_pos, ref_count, query_count, var, skew, kurt) of other's counts against this."""
        return tuple(combine.compare_counts(other._rows(), self._rows()).first())

    def compare_matrix(self, *others: Sketch) -> list[list[int]]:
        """Each other sketch's counts of this one's hashes."""
        if not others:
            return []
        c = Collection.from_sketches(others)
        found = combine.matrix_rows(combine.count_matrix(self._rows(), c.minmers, "sketch_id"), "sketch_id").collect()
        by = {r["sketch_id"]: r["counts"] for r in found}
        ids = [r[0] for r in c.sketches.select("sketch_id").orderBy("sketch_id").collect()]
        return [by.get(i, [0] * len(self)) for i in ids]
