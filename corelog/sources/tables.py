"""Sources and sinks: Parquet, CSV, JSON and text files by a registry of formats; manifests, shards, covariates."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corelog.functions.digest import Digest, can_carry
from corelog.operators.common import kept
from corelog.plans.ship import ship

_SUFFIX = {".parquet": "parquet", ".csv": "csv", ".gz": "csv", ".json": "json", ".jsonl": "json", ".txt": "text", ".xml": "binaryFile", ".html": "binaryFile"}


def read(spark: SparkSession, spec: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table by 'format:path', else by the path's suffix. CSV and JSON need a schema: types are never inferred, so that
    '2.10' stays text; rows that don't fit it are errors."""
    fmt, _, path = spec.partition(":")
    if fmt not in {"parquet", "csv", "json", "text", "binaryFile"}:
        fmt, path = _SUFFIX.get(PurePosixPath(spec.rstrip("*/")).suffix, "parquet"), spec
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema")
    if fmt == "csv":
        r = r.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    df = r.load(path)
    return df.select(*columns) if columns else df


def union_files(spark: SparkSession, specs: list[str], schema: StructType | str, *, tolerant: bool = False) -> DataFrame:
    """All rows of several files or globs, gzip included; columns that one lacks are NULL.

    tolerant: CSV files may have some of the schema's columns only, in any order, and a spec that matches nothing is passed over.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = None
    for s in specs:
        try:
            if tolerant:
                have = spark.read.option("header", True).csv(s.partition(":")[2] if s.startswith("csv:") else s).columns
                one = read(spark, s, StructType([StructField(c, kinds[c]) if c in (kinds := {f.name: f.dataType for f in wanted}) else StructField(c, StringType()) for c in have]))
                one = one.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
            else:
                one = read(spark, s, wanted)
        except AnalysisException as e:
            if tolerant and "PATH_NOT_FOUND" in str(e):
                continue
            raise
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"nothing matches {specs}")
    return out


def write(df: DataFrame, path: str, fmt: str = "parquet", *, by: list[str] | None = None, decimals: dict[str, int] | None = None) -> None:
    """df as files, committed as a whole by Spark's protocol; CSV columns in `decimals` have that many digits."""
    if fmt == "csv" and decimals:
        df = df.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in decimals.items()})
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w = w.option("header", True)
    if fmt == "parquet":
        w = w.option("compression", "zstd")
    w.format(fmt).save(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of a binaryFile scan."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def manifest_differences(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, why) of what a manifest doesn't describe: 'unlisted', 'missing', or 'changed' where digest or size differ."""
    now = manifest(files).select("path", F.struct("sha256", "size").alias("_now"))
    was = listed.select("path", F.struct("sha256", "size").alias("_was"))
    why = F.when(F.col("_was").isNull(), "unlisted").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("_was"), "changed")
    return now.join(was, "path", "full").select("path", why.alias("why")).where("why IS NOT NULL")


def combine_shards(shards: list[DataFrame], keys: list[str], needed: list[str]) -> DataFrame:
    """The rows of all shards that have the needed columns (others are passed over); ValueError if none has, or if a key
    stands in two shards."""
    good = [s for s in shards if set(needed) <= set(s.columns)]
    if not good:
        raise ValueError("no shard has the needed columns")
    whole = None
    for i, s in enumerate(good):
        s = s.withColumn("_shard", F.lit(i))
        whole = s if whole is None else whole.unionByName(s, allowMissingColumns=True)
    twice = whole.groupBy(*keys).agg(F.min("_shard").alias("_a"), F.max("_shard").alias("_b")).where("_a <> _b").limit(1).collect()
    if twice:
        raise ValueError(f"a key stands in two shards: {twice[0].asDict()}")
    return whole.drop("_shard")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system; FileNotFoundError if none does."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(f"none of {paths}")


class Registry:
    """Named covariates, each a function from located points (key, lat, lon) to (key, value); categorical ones are kept apart."""

    def __init__(self, loaders: dict[str, tuple[str, object]] | list[tuple[str, str, object]]):
        """loaders: (name, 'continuous' or 'categorical', function); an empty list or a repeated name is a ValueError."""
        rows = [(n, *v) for n, v in loaders.items()] if isinstance(loaders, dict) else list(loaders)
        if not rows or len({n for n, *_ in rows}) < len(rows):
            raise ValueError("covariates need names, each once")
        self.loaders = {n: (kind, f) for n, kind, f in rows}

    def names(self, kind: str | None = None) -> list[str]:
        return [n for n, (k, _) in self.loaders.items() if kind in (None, k)]

    def sample(self, points: DataFrame, key: str, kind: str | None = None) -> DataFrame:
        """points with a column for each covariate (of the kind), joined on the key; NULL where a covariate has no value."""
        out = points
        for n in self.names(kind):
            out = out.join(self.loaders[n][1](points).select(key, F.col("value").alias(n)), key, "left")
        return out

    def stack(self, points: DataFrame, key: str) -> DataFrame:
        """(key, features): the continuous covariates as one array, in the order of their names here."""
        return self.sample(points, key, "continuous").select(key, F.array(*[F.col(n).cast("double") for n in self.names("continuous")]).alias("features"))


#: Bytes of a piece of the joined texts, and of the pieces that one task digests.
PIECE_BYTES = 256 << 10
STEP_BYTES = 64 << 20


def content_key(df: DataFrame, order: str, text: str, *, piece: int = PIECE_BYTES, step: int = STEP_BYTES) -> DataFrame:
    """One row: the first 16 digits of the sha256 of all texts in order, joined by NUL characters; NULL counts as empty.

    A digest of a whole is sequential by definition. Texts are sorted and joined to pieces in parallel; then task after task
    digests some `step` bytes of pieces and hands its state on, so that none reads more, however large the table is. Where
    Python has no libcrypto, whose state can be handed on, one task digests all pieces.
    """
    spark = df.sparkSession
    ship(spark)
    # A row without an order comes last, as in SQL.
    joined = df.orderBy(F.col(order).asc_nulls_last()).select(text).mapInArrow(_pieces(piece), "part int, place int, size int, bytes binary")
    pieces = kept(joined, "pieces", by=["part"])
    sizes = [tuple(r) for r in pieces.select("part", "place", "size").orderBy("part", "place").collect()]
    steps, state, key = steps_of(sizes, step), None, hashlib.sha256().hexdigest()
    for i, (first, last) in enumerate(steps):
        state, key = _digested(pieces, first, last, state, i == 0, len(steps) == 1)
        if key is None:
            state, key = _digested(pieces, steps[0][0], steps[-1][1], None, True, True)
            break
    return spark.createDataFrame([(key[:16],)], "key string")


def steps_of(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(first, last) of runs of pieces (part, place, size) in their order, each of `most` bytes or of one piece."""
    out, held = [], 0
    for part, place, size in sizes:
        if out and held + size <= most:
            out[-1], held = (out[-1][0], (part, place)), held + size
        else:
            held = size
            out.append(((part, place), (part, place)))
    return out


def _pieces(most: int):
    """For mapInArrow: a partition's texts, each after a NUL, as (part, place, size, bytes) of `most` bytes; the last has what is left."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, place, rest = TaskContext.get().partitionId(), 0, bytearray()

        def piece():
            data = bytes(rest[:most])
            del rest[:most]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([len(data)], pa.int32()), pa.array([data], pa.binary())], ["part", "place", "size", "bytes"])

        for batch in batches:
            for t in batch.column(0):
                rest += b"\0"
                if t.is_valid:
                    rest += t.as_buffer()
                while len(rest) >= most:
                    yield piece()
                    place += 1
        if rest:
            yield piece()

    return run


def _digested(pieces: DataFrame, first: tuple[int, int], last: tuple[int, int], state: bytes | None, begins: bool, alone: bool) -> tuple[bytes | None, str | None]:
    """(state, digest) after the pieces from first to last, in one task; (None, None) if it can't hand its state on but must."""

    def run(batches):
        import pyarrow as pa

        carries, at = can_carry(), 0 if not begins else 1  # the first text has no NUL before it
        if carries or alone:
            digest = Digest(state) if carries else hashlib.sha256()
            for batch in batches:
                for b in batch.column(0):
                    digest.update(b.as_py()[at:])
                    at = 0
        out = [digest.state() if carries else None, digest.hexdigest() if carries or alone else None]
        yield pa.RecordBatch.from_arrays([pa.array(out[:1], pa.binary()), pa.array(out[1:], pa.string())], ["state", "key"])

    within = f"part BETWEEN {first[0]} AND {last[0]} AND (part > {first[0]} OR place >= {first[1]}) AND (part < {last[0]} OR place <= {last[1]})"
    row = pieces.where(within).coalesce(1).sortWithinPartitions("part", "place").select("bytes").mapInArrow(run, "state binary, key string").collect()[0]
    return (None if row.state is None else bytes(row.state)), row.key
