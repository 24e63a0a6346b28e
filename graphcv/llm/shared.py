"""What every operator of this subpackage needs: the shared folder, shipped code, tables written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="graphcv-"), "graphcv_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where it is unset, a new local folder serves in
    local mode (tests) only; on a cluster that would be another disk for each executor, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphcv-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, and its size is known to the planner.
    codec: how its pages are compressed, where that is not the session's choice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphcv-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A written table to broadcast if it has `limit` bytes at most when its rows are laid out, else to shuffle. The rows are counted, and
    each takes what its type needs; strings and arrays count by their length."""
    wide = sum((F.length(c) if t in ("string", "binary") else F.size(c) * 40 if t.startswith("array") else F.lit(16) for c, t in df.dtypes), F.lit(16))
    size = df.agg(F.sum(wide)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def id_values(column: str, descending: bool = False) -> list:
    """Three double columns that order 64-bit ids exactly, nulls last: whether it is null, its high and its low half."""
    number = F.coalesce(F.col(column), F.lit(0).cast("long"))
    high, low = F.shiftright(number, 32).cast("double"), number.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
    return [F.col(column).isNull().cast("double"), -high if descending else high, -low if descending else low]


def in_ranges(df: DataFrame, values: list[str], most: int, weight: str | None = None, name: str = "block", rounds: int = 40) -> DataFrame:
    """`df` with `name`, an array<long>: blocks that follow each other in the order of the double columns `values` (no nulls).

    A block has about `most` rows (or as much of `weight`), and four times as many at most, unless all its values are equal. Blocks
    are cut where they are too large: evenly between the least and the largest of the first value that differs in them,
    and again as long as that leaves large ones, so one outlying value does no harm. They hang on the values alone, not
    on how the rows lie. Only counts and limits of blocks are gathered, never rows.
    """
    out = df.withColumn(name, F.array().cast("array<bigint>"))
    load = F.sum(weight) if weight else F.count("*")
    for turn in range(rounds):
        stats = out.groupBy(name).agg(load.alias("_n"), *[f(v).alias(f"_{k}{i}") for i, v in enumerate(values) for k, f in (("lo", F.min), ("hi", F.max))])
        differs = [F.col(f"_lo{i}") < F.col(f"_hi{i}") for i in range(len(values))]
        which = F.coalesce(*[F.when(d, i) for i, d in enumerate(differs)])
        large = stats.where(F.col("_n") > (4 * most if turn else most)).select(name, F.ceil(F.col("_n") / most).cast("double").alias("_parts"), which.alias("_which"), *[f"_{k}{i}" for i in range(len(values)) for k in ("lo", "hi")])
        large = written(large.where("_which is not null"), "large-ranges")
        if large.isEmpty():
            break
        place = F.coalesce(*[F.when(F.col("_which") == i, F.least(F.col("_parts") - 1, F.floor((F.col(v) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col("_parts")))) for i, v in enumerate(values)])
        met = out.join(small(large), name, "left")
        out = met.withColumn(name, F.when(F.col("_parts").isNull(), F.col(name)).otherwise(F.array_append(name, place.cast("long")))).drop(*[c for c in large.columns if c != name])
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value, f):
    """f(value) with value evaluated once: inside a lambda, a plain column would be evaluated anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
