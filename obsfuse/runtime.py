"""Session construction and the two physical helpers every operator shares."""

from __future__ import annotations

import contextlib
import functools
import operator
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}

#: Largest row count that may be handed to a broadcast join or to the driver.
BROADCAST_ROW_LIMIT = 200_000


def session(app: str = "obsfuse", cores: int | str = "*", **conf: object) -> SparkSession:
    """Build a local session with the settings the library is tested under.

    On a cluster the caller brings its own session; nothing below depends on
    these values except the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    A local master may do without one and gets a temporary folder; a cluster must name one,
    since a folder of one machine is not seen by the others.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, wherever they run."""
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="obsfuse-")) / "obsfuse.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED["application"] = context.applicationId


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and cut its lineage.

    Used where a later step must see exactly the same row placement twice (range
    slices) or where an iterative fit would otherwise grow its plan without bound.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def placed(df: DataFrame) -> DataFrame:
    """:func:`durable` for rows that have been dealt by a part of their keys.

    They are written by a fixed plan: tables that are dealt alike are joined where they lie, and the rows written are
    known to lie so, hence groups and windows over these keys move nothing.  Adaptive plans forget it at the first write.
    Filters that follow from joins (known keys) are not pushed down: they would keep two readings of a table from
    sharing one shuffle.
    """
    fixed = {"adaptive.enabled": "false", "requireAllClusterKeysForCoPartition": "false", "constraintPropagation.enabled": "false"}
    with _settings(df.sparkSession, {f"spark.sql.{name}": value for name, value in fixed.items()}):
        return durable(df)


def within_limit(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` holds at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Add a broadcast hint only behind a row-count check."""
    return F.broadcast(df) if within_limit(df, limit) else df


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return functools.reduce(operator.and_, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(
    facts: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salt: int = 16,
    salt_by: Iterable[str] | None = None,
    merge: bool = False,
) -> DataFrame:
    """Join one-row-per-key ``stats`` back onto ``facts`` without a hot-key task.

    ``stats`` is replicated ``salt`` times and every fact row goes to the replica
    chosen by a hash of its own columns, so a key that owns a third of the facts is
    spread over ``salt`` reducers.  Spark may still turn it into a broadcast join
    when it knows ``stats`` is small.  It does not count the replicas there: with
    ``merge``, for ``stats`` that grow with the facts, no such join is planned.
    """
    keys = list(keys)
    if not keys:
        return facts.join(F.broadcast(stats), how="cross")  # exactly one stats row
    hashed = [F.col(c) for c in (salt_by or [c for c in facts.columns if not _complex(facts, c)])]
    left = facts.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salt)).cast("int"))
    right = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    if merge:
        right = right.hint("merge")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def attach_few(facts: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left", salt_by: Iterable[str] | None = None) -> DataFrame:
    """:func:`attach` for written ``stats`` that are mostly few: then they are broadcast and the facts stay where they are."""
    if within_limit(stats):
        return facts.join(F.broadcast(stats), list(keys), how)
    return attach(facts, stats, keys, how, salt_by=salt_by)


def _complex(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in {"map", "variant"}


def violations(df: DataFrame, message: str) -> None:
    """Raise when a guard query returns any row (stops at the first one)."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict(recursive=True)}")
