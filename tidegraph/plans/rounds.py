"""State that is carried from one round of a job to the next."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names; on one machine a new one will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside have their shuffle files removed at once: what they gave is kept elsewhere."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


#: How a shuffle is dealt out inside ``fine_parts``: so many parts at first, which are put together up to a size, and
#: files are read in splits of that size: what a task folds before a shuffle grows with its split.
FINE = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
}


@contextmanager
def fine_parts(spark: SparkSession) -> Iterator[None]:
    """Shuffles that run inside have many parts, so that a task's share does not grow with the input; small ones are put together."""
    before = {name: spark.conf.get(name, None) for name in FINE}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in FINE.items():
        spark.conf.set(name, str(max(int(value), parts)) if value.isdigit() else value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@dataclass(frozen=True)
class Lying:
    """How a state lies: in so many parts by the hash of ``by``, each of them sorted."""

    by: str
    parts: int
    order: str


def staged(df: DataFrame, name: str = "state", lying: Lying | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; ``name`` says what it holds.

    Plans stay short however many rounds follow, a lost executor costs a re-read
    instead of the rounds so far, and the planner sees what the state really
    takes up: a size estimate is never carried from one round into the next.
    States that lie alike are joined and grouped by that column without a shuffle.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        # Nobody waits for a mark of success here.
        writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        if lying is None:
            writer.parquet(path)
        else:
            writer.format("parquet").bucketBy(lying.parts, lying.by).sortBy(lying.order).option("path", path).saveAsTable(_table(path))
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path) if lying is None else spark.table(_table(path))
    out._state_path = path
    return out


def _table(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def unbound(state: DataFrame) -> DataFrame:
    """A state that lies in parts, as a plain one that the catalog does not name any more."""
    spark, path = state.sparkSession, state._state_path
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    out = spark.read.schema(state.schema).parquet(path)
    out._state_path = path
    return out


def measured(df: DataFrame, name: str = "state", lying: Lying | None = None, **sums: Column) -> tuple[DataFrame, Row]:
    """``staged``, and aggregates over its rows that are taken while it is written, without a job of their own.

    ``df`` must have rows: a plan that is known to be empty takes no measures.
    """
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    out = staged(df.observe(watch, *[c.alias(n) for n, c in sums.items()]), name, lying)
    return out, Row(**watch.get)


def _remove(spark: SparkSession, path: str) -> None:
    # The catalog names states that lie in parts; it leaves their files alone.
    if spark.catalog.tableExists(_table(path)):
        spark.sql(f"DROP TABLE {_table(path)}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget(*states: DataFrame) -> None:
    """Removes the files of states that no later plan reads; frames that are no states are left alone."""
    for state in states:
        path = getattr(state, "_state_path", None)
        if path is not None:
            _remove(state.sparkSession, path)


#: Paths of the states written inside each operator that is running, innermost last.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def tidy(operator: Callable) -> Callable:
    """An operator whose result is a state, and whose own states are removed when it ends or fails.

    The result may be a frame or a tuple of frames and other values; what is left
    in the shared folder does not grow with the number of rounds.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        _SCOPES.append([])
        try:
            found = operator(*args, **kwargs)
            own, _SCOPES[-1] = _SCOPES[-1], []
            parts = found if isinstance(found, tuple) else (found,)
            parts = tuple(staged(p, operator.__name__) if isinstance(p, DataFrame) else p for p in parts)
            kept, _SCOPES[-1] = _SCOPES[-1], own
            if len(_SCOPES) > 1:
                _SCOPES[-2].extend(kept)
            return parts if isinstance(found, tuple) else parts[0]
        finally:
            for spark, path in _SCOPES.pop():
                _remove(spark, path)

    return run


class RoundLimit(RuntimeError):
    """The state still changed after the allowed number of rounds."""
