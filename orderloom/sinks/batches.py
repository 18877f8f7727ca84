"""Tables written in batches that appear whole or not at all, and are never overwritten.

A root folder holds tables and a commit log. A batch writes its rows of every table under a new
attempt, ``<root>/<table>/attempt=<id>``, and is visible once its one-row commit file is there.
Readers take the attempts that the log names and nothing else: what a failed attempt left behind is
never read, and a reader sees all tables of a batch or none.

A batch is named by its run and its number in the run. Two runs on one root cannot touch each other's
batches, and a batch of a run that is already committed is not written again. One writer per run.

A batch's rows are in a folder for each value of the columns it is partitioned by, or, for a large one, mixed in
files of their own (``mixed``): neighbours that share their values then take next to nothing more, while a filter
on such a column reads all files of the batch. The attempt's name tells which; ``read`` gives the rows of both.

Compaction and retention add rows to the log that replace attempts; files go only with ``vacuum``. A
compacted table keeps each row's first attempt as its ``origin``, so that what a batch wrote can be read
wherever compactions have put it (``read_origins``). The log also has each batch's row counts and last
event time, seen by the pass that writes it, so retention and offsets need not read the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders a task writes side by side, without sorting its rows by folder first; more folders are sorted.
_OPEN_FOLDERS = ("spark.sql.maxConcurrentOutputFileWriters", "16")

# What a write has shuffled is deleted when it ends, not when the driver next collects garbage.
_CLEAN_UP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

# Order numbers next to each other share digits, which only this version's encodings use; any reader knows both.
# Pages end at a megabyte, not at 20,000 rows, and are compressed harder: a column of an order's events is a few
# bytes a row, and small pages share little.
_FORMAT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "9",
    "parquet.page.row.count.limit": "1000000",
    "parquet.writer.version": "PARQUET_2_0",
}

# Attempts whose rows are mixed have names that begin so.
_MIXED = "mixed-"

# What the row before has too, or the one some rows earlier, is left to the compression: places in a dictionary,
# packed into bits, would hide it. These pages, unlike later versions', have the places of nulls compressed too.
MIXED_FORMAT = {
    **_FORMAT,
    "parquet.writer.version": "PARQUET_1_0",
    "parquet.page.size": str(4 << 20),
    **{
        f"parquet.enable.dictionary#{name}": "false"
        for name in ("do_key", "item_number", "location", "account_number", "amount", "quantity")
    },
}

_BY_TABLE = T.MapType(T.StringType(), T.LongType())
COMMIT = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("position", T.LongType()),  # order of commits, from 1
        T.StructField("attempt", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("replaces", T.ArrayType(T.StringType())),  # attempts no longer read
        T.StructField("sizes", _BY_TABLE),  # rows written to each table
        T.StructField("latest", _BY_TABLE),  # last event time of the tables that have one
    ]
)


def _log(root: str) -> str:
    return f"{root}/commits"


def open_store(spark: SparkSession, root: str) -> None:
    """Makes an empty commit log where there is none, so that a stream can follow it."""
    try:
        spark.read.schema(COMMIT).parquet(_log(root))
    except AnalysisException:
        spark.createDataFrame([], COMMIT).coalesce(1).write.mode("append").parquet(_log(root))


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commit log; no rows where nothing was ever committed."""
    try:
        return spark.read.schema(COMMIT).parquet(_log(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, root: str, run: str, batch_id: int) -> bool:
    known = (F.col("run") == run) & (F.col("batch_id") == batch_id)
    return not commits(spark, root).filter(known).isEmpty()


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for one write."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def cleaned_up(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files behind."""
    return _set(spark, *_CLEAN_UP)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder. Needs a classic session."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Batch:
    """Writes the tables of one batch; nothing is visible before ``commit``."""

    def __init__(self, spark: SparkSession, root: str, run: str, batch_id: int, mixed: bool = False):
        self.spark, self.root, self.run, self.batch_id, self.mixed = spark, root, run, batch_id, mixed
        self.attempt, self.tables = f"{_MIXED if mixed else ''}{uuid.uuid4().hex}", []
        self.sizes, self.latest = {}, {}

    def path(self, table: str) -> str:
        self.tables.append(table)
        return f"{self.root}/{table}/attempt={self.attempt}"

    def write(
        self,
        rows: DataFrame,
        table: str,
        *partition_by: str,
        watch: dict[str, Column] | None = None,
        into: str | None = None,
    ) -> dict:
        """Writes the rows; gives what the aggregates in ``watch`` are over them, from the same pass.

        ``into`` names a table over this one's folder that is partitioned by attempt and says how files are written.
        """
        watch = watch or {}
        seen, wanted = Observation(), [F.count(F.lit(1)).alias("n")]
        wanted += [value.alias(name) for name, value in watch.items()]
        if "event_time" in rows.columns:
            wanted.append(F.max("event_time").alias("latest"))
        watched = rows.observe(seen, *wanted)
        writer = watched.write.mode("errorifexists").options(**_FORMAT)
        writer = writer.options(**MIXED_FORMAT) if self.mixed else writer.partitionBy(*partition_by)
        with _set(rows.sparkSession, *_OPEN_FOLDERS), cleaned_up(rows.sparkSession):
            path = self.path(table)
            if into is None:
                writer.parquet(path)
            else:
                watched.withColumn("attempt", F.lit(self.attempt)).write.insertInto(into)
                # Without rows nothing has made the folder yet.
                self.spark.sql(f"ALTER TABLE {into} ADD IF NOT EXISTS PARTITION (attempt = '{self.attempt}')")
        self.sizes[table] = seen.get["n"]
        if seen.get.get("latest") is not None:
            self.latest[table] = seen.get["latest"]
        return {name: seen.get[name] for name in watch}

    def commit(self, replaces: Iterable[str] = (), position: int | None = None, empty: bool = False) -> None:
        """Makes the batch visible; an ``empty`` one only replaces others."""
        if position is None:
            last = commits(self.spark, self.root).agg(F.max("position")).first()[0]
            position = 1 + (last or 0)
        attempt = None if empty else self.attempt
        row = (self.run, self.batch_id, position, attempt, self.tables, list(replaces), self.sizes, self.latest)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(_log(self.root))


def append(
    rows: DataFrame,
    root: str,
    table: str,
    run: str,
    batch_id: int,
    *partition_by: str,
    mixed: bool = False,
    into: str | None = None,
) -> bool:
    """Adds one batch to one table; False if the run has committed that batch before."""
    spark = rows.sparkSession
    if is_committed(spark, root, run, batch_id):
        return False
    batch = Batch(spark, root, run, batch_id, mixed)
    batch.write(rows, table, *partition_by, into=into)
    batch.commit()
    return True


def _live(rows: list) -> list:
    """Commits of a table that count, oldest first; commits at the same position by run."""
    gone = {a for r in rows for a in r["replaces"]}
    # Of two commits of one batch, by writers that broke the rule, the first counts.
    first: dict[tuple, object] = {}
    for r in sorted((r for r in rows if r["attempt"] and r["attempt"] not in gone), key=_order):
        first.setdefault((r["run"], r["batch_id"]), r)
    return list(first.values())


def _order(commit) -> tuple:
    return commit["position"], commit["run"], commit["attempt"]


def _commits_of(spark: SparkSession, root: str, table: str) -> list:
    return commits(spark, root).filter(F.array_contains("tables", table)).collect()


def is_mixed(attempt: str) -> bool:
    """Whether an attempt has no folders by the columns of its rows."""
    return attempt.startswith(_MIXED)


def attempts(spark: SparkSession, root: str, table: str, after: int = 0) -> list[tuple[int, str]]:
    """``(position, attempt)`` of the batches of a table that count, oldest first.

    One entry for each batch since the last compaction; ``after`` leaves out batches up to a position.
    """
    return [(r["position"], r["attempt"]) for r in _live(_commits_of(spark, root, table)) if r["position"] > after]


def read(
    spark: SparkSession, root: str, table: str, schema: T.StructType, only: Iterable[str] | None = None, after: int = 0
) -> DataFrame:
    """Rows of the committed attempts, which are the only folders listed. ``schema`` may name ``attempt``."""
    chosen = list(only) if only is not None else [a for _, a in attempts(spark, root, table, after)]
    rows = []
    for some in ([a for a in chosen if not is_mixed(a)], [a for a in chosen if is_mixed(a)]):
        if some:
            paths = [f"{root}/{table}/attempt={attempt}" for attempt in some]
            found = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths)
            rows.append(found.select(*schema.fieldNames()))
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], schema)


def read_origins(
    spark: SparkSession, root: str, table: str, schema: T.StructType, wanted: Iterable[str]
) -> DataFrame:
    """What the named attempts wrote, as far as it still counts.

    An attempt that compactions have replaced is read from where its rows are now; one that retention
    gave up has none. ``schema`` may not name ``attempt``.
    """
    log = _commits_of(spark, root, table)
    live = {r["attempt"] for r in _live(log)}
    follows = {a: r["attempt"] for r in log for a in r["replaces"]}
    in_place, moved = [], {}
    for attempt in wanted:
        at = attempt
        while at in follows:
            at = follows[at]
        if at == attempt and at in live:
            in_place.append(at)
        elif at in live:
            moved.setdefault(at, []).append(attempt)
    rows = read(spark, root, table, schema, in_place)
    if moved:
        marked = T.StructType([*schema.fields, T.StructField("origin", T.StringType())])
        origins = [a for attempts_ in moved.values() for a in attempts_]
        compacted = read(spark, root, table, marked, moved).filter(F.col("origin").isin(origins))
        rows = rows.unionByName(compacted.select(*schema.fieldNames()))
    return rows


def compact(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: tuple[str, ...] = (),
    keep_origin: bool = False,
) -> None:
    """Rewrites a table's batches as one; ``combine`` may drop rows that no longer count.

    With ``keep_origin`` each row remembers the attempt that first wrote it, which streams that follow
    the table need.
    """
    old = attempts(spark, root, table)
    if len(old) < 2:
        return
    if keep_origin:
        marks = [T.StructField(name, T.StringType()) for name in ("attempt", "origin")]
        rows = read(spark, root, table, T.StructType([*schema.fields, *marks]))
        rows = rows.withColumn("origin", F.coalesce("origin", "attempt")).drop("attempt")
    else:
        rows = read(spark, root, table, schema)
    batch = Batch(spark, root, f"compact {table}", old[-1][0])
    batch.write(rows if combine is None else combine(rows), table, *partition_by)
    batch.commit([attempt for _, attempt in old], position=old[-1][0])


def retain(spark: SparkSession, root: str, table: str, after: int) -> None:
    """Retention: batches of a table up to a position are read no more. Other tables keep theirs."""
    old = [(position, attempt) for position, attempt in attempts(spark, root, table) if position <= after]
    if old:
        batch = Batch(spark, root, f"retain {table}", after)
        batch.tables.append(table)
        batch.commit([attempt for _, attempt in old], position=old[-1][0], empty=True)


def position_before_last(spark: SparkSession, root: str, table: str, rows: int) -> int:
    """The position up to which a table's batches can go so that its last ``rows`` rows stay.

    Batches go whole, so up to one batch more than asked for stays; the counts are in the log.
    """
    newer = 0
    for commit in reversed(_live(_commits_of(spark, root, table))):
        if newer >= rows:
            return commit["position"]
        newer += commit["sizes"][table]
    return 0


def vacuum(spark: SparkSession, root: str, table: str) -> None:
    """Deletes the files of attempts that a commit has replaced. Needs a classic session."""
    log = commits(spark, root).collect()
    gone = {a for r in log if table in r["tables"] for a in r["replaces"]}
    for attempt in gone:
        delete(spark, f"{root}/{table}/attempt={attempt}")
