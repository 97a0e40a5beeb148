"""Labelled numeric tables: loading, encoding, scaling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidform.functions.formulas import sanitize


@dataclass(frozen=True)
class Labelled:
    """A table with numeric feature columns, a 0/1 label and a row identity.

    ``rid`` is a string column; ties between equal identities do not change
    results because such rows are interchangeable.
    """

    df: DataFrame
    features: tuple[str, ...]
    label: str = "y"
    rid: str = "rid"

    def with_df(self, df: DataFrame) -> Labelled:
        return replace(self, df=df)

    def select_features(self, ids: Sequence[int]) -> Labelled:
        """Column subset; names stay as they are."""
        names = tuple(self.features[i] for i in ids)
        rest = [c for c in self.df.columns if c not in self.features]
        return replace(self, df=self.df.select(*rest, *names), features=names)

    def augmented(self, columns: dict[str, Column]) -> Labelled:
        """Raw features followed by derived ones."""
        return replace(self, df=self.df.withColumns(columns), features=(*self.features, *columns))


def load_labelled(
    df: DataFrame,
    features: dict[str, Column],
    label: Column,
    rid: Column | None = None,
    extra: Sequence[Column] = (),
) -> Labelled:
    """Feature columns made finite, the label as 0/1, and a row identity."""
    rid = F.lit("") if rid is None else rid
    out = df.select(
        rid.alias("rid"),
        *[sanitize(c.cast("double")).alias(n) for n, c in features.items()],
        F.when(label, 1).otherwise(0).alias("y"),
        *extra,
    )
    return Labelled(out, tuple(features))


def split_numeric_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of numeric columns and of the other scalar columns, in schema order."""
    numeric, other = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            other.append(f.name)
    return numeric, other


def category_codes(fit: DataFrame, column: str) -> DataFrame:
    """(column, code): the sorted distinct values numbered from 0.

    Distinct values are range-partitioned, counted per partition and numbered
    there, so a column with very many values is not sorted in one task.
    """
    from lucidform.operators.ranking import dense_codes

    return dense_codes(fit.where(F.col(column).isNotNull()).select(column).distinct(), column)


def ordinal_encode(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """``<column>_code`` per column: rank among the fitted values, -1 when unseen."""
    fit = df if fit is None else fit
    out = df
    for c in columns:
        codes = category_codes(fit, c).withColumnRenamed("code", f"{c}_code")
        out = out.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1)).cast("double"))
    return out


def binarize_label(df: DataFrame, column: str, positive: str | None = None, out: str = "y") -> DataFrame:
    """Named positive class, or the last class in sort order, against the rest."""
    if positive is not None:
        return df.withColumn(out, F.when(F.col(column) == positive, 1).otherwise(0))
    last = df.agg(F.max(column).alias("_last"))  # one row
    return df.crossJoin(F.broadcast(last)).withColumn(out, F.when(F.col(column) == F.col("_last"), 1).otherwise(0)).drop("_last")


def standardize(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std with statistics of ``fit``; zero std divides by one."""
    fit = df if fit is None else fit
    stats = fit.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    joined = df.crossJoin(F.broadcast(stats))  # one row of statistics
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*stats.columns)


def densify(df: DataFrame, column: str, out: str = "x") -> DataFrame:
    """ML vectors, sparse or dense, as an array of doubles."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(out, vector_to_array(F.col(column)))


def array_features(df: DataFrame, column: str, size: int, prefix: str = "e") -> tuple[DataFrame, tuple[str, ...]]:
    names = tuple(f"{prefix}{i}" for i in range(size))
    return df.select("*", *[F.col(column)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


# --- the given tables as labelled tables -----------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returned_items(spark: SparkSession, sf_dir: str) -> Labelled:
    """Line items with four numeric features, label = returned."""
    return load_labelled(
        table(spark, sf_dir, "lineitem"),
        {
            "qty": F.col("l_quantity"),
            "price": F.col("l_extendedprice"),
            "disc": F.col("l_discount"),
            "tax": F.col("l_tax"),
        },
        F.col("l_returnflag") == "R",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    )


def embedded_items(spark: SparkSession, sf_dir: str, positive: int = 3, size: int = 64) -> Labelled:
    df, names = array_features(table(spark, sf_dir, "embeddings"), "embedding", size)
    return load_labelled(
        df,
        {n: F.col(n) for n in names},
        F.col("label") == positive,
        F.col("vec_id").cast("string"),
        extra=[F.col("label")],
    )


def _over_kept(df: DataFrame) -> bool:
    """Whether the plan only filters and projects rows that are kept, and spread, already."""
    node = df._jdf.queryExecution().withCachedData()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.nodeName() != "InMemoryRelation":
        return False
    parts = node.cacheBuilder().cachedPlan().outputPartitioning().numPartitions()  # 0 where rows were kept as they were read
    return parts == 0 or parts >= df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """More partitions for a table that is read in fewer tasks than there are cores.

    Looks at the file list and sizes only, so nothing is executed; a table in many files
    or large ones is left as it is, and so are rows that are kept already.
    """
    from lucidform.operators.ranking import source_bytes

    if df.isStreaming or _over_kept(df):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(n) if max(len(df.inputFiles()), source_bytes(df) // split) < n else df


def hashed(lab: Labelled) -> Labelled:
    """The columns of a search, with a hash for the row identity: a row that is kept then takes eight bytes a column.
    Not for folds, whose order is that of the identities."""
    return lab.with_df(lab.df.select(F.xxhash64(lab.rid).alias(lab.rid), lab.label, *lab.features))


@contextmanager
def working_copy(lab: Labelled, moved: bool = False) -> Iterator[Labelled]:
    """The columns a search reads again and again, spread over the cluster and kept
    (memory first, then disk); lost blocks are recomputed from the source.

    Rows that come out of a shuffle (``moved``) are spread already; projections of kept rows aren't kept once more."""
    df = lab.df
    if not df.isStreaming and (df.storageLevel.useMemory or _over_kept(df)):
        yield lab
        return
    df = (df if moved else spread(df)).persist()
    try:
        yield lab.with_df(df)
    finally:
        df.unpersist()
