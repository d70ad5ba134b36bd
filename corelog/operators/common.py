"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.plans.shared import shared_dir

#: Tables of up to so many rows are broadcast by bounded(); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or KeyError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float columns with NaN replaced by NULL: from here on a missing value has one form."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in kinds.items() if t in ("float", "double")})


def hashed(seed: int, *keys: Column | str) -> Column:
    """md5 of 'seed|key|...': the pseudo-random order of samples, splits and permutations, equal in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("nan")) for k in keys]))


def kept(df: DataFrame, what: str, *, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by `by`: computed once, whatever reads it, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, what: str = "side") -> DataFrame:
    """df, written once, with a broadcast hint if its rows are counted to be few; what it takes to compute it is not done again."""
    df = kept(df, what)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or ValueError if a key stands twice: the right side of an m:1 join."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique on {keys}: {twice[0]}")
    return df
