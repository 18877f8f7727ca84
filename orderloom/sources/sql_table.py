"""The stored events under a SQL name that follows the commit log."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orderloom.schemas import EVENT_COLUMNS, EVENT_TYPES, STORED_EVENT
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS

STATEMENT = 700  # partitions named in one statement


def _partitions(attempts: list[str], mixed: bool) -> list[str]:
    if mixed:
        return [f"PARTITION (attempt = '{a}')" for a in attempts]
    return [f"PARTITION (attempt = '{a}', event_name = '{e}')" for a in attempts for e in EVENT_TYPES]


def sync_event_table(spark: SparkSession, name: str, root: str) -> None:
    """Makes ``name`` show the events that count now; to be called after commits, retention, compaction.

    ``name`` is a view on ``<name>_files``, a table over the store's folders, and ``<name>_mixed``, one over its
    batches without folders by type. Partitions of new attempts are added first, then the view turns to the
    attempts that count, in one step, and last the partitions of replaced ones go. So a query sees the store as it
    was before or as it is after, nothing twice and nothing missing. Dropping partitions deletes no files; those
    are ``vacuum``'s.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED_EVENT.fields)
    live = [attempt for _, attempt in batches.attempts(spark, root, EVENTS)]
    shown, dropped = [], []
    for mixed, files, folders in ((False, f"{name}_files", "attempt, event_name"), (True, f"{name}_mixed", "attempt")):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {files} ({columns}) USING parquet "
            f"PARTITIONED BY ({folders}) LOCATION '{root}/{EVENTS}'"
        )
        own = [attempt for attempt in live if batches.is_mixed(attempt) == mixed]
        parts = spark.sql(f"SHOW PARTITIONS {files}").select(F.regexp_extract("partition", "attempt=([^/]*)", 1).alias("attempt"))
        known = {r["attempt"] for r in parts.distinct().collect()}
        new = _partitions([attempt for attempt in own if attempt not in known], mixed)
        for low in range(0, len(new), STATEMENT):
            spark.sql(f"ALTER TABLE {files} ADD IF NOT EXISTS {' '.join(new[low : low + STATEMENT])}")
        if own or not mixed:
            counts = f"attempt IN ({', '.join(repr(a) for a in own)})" if own else "false"
            shown.append(f"SELECT {', '.join(EVENT_COLUMNS)} FROM {files} WHERE {counts}")
        dropped.append((files, _partitions(sorted(known - set(own)), mixed)))
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {' UNION ALL '.join(shown)}")
    for files, gone in dropped:
        for low in range(0, len(gone), STATEMENT):
            spark.sql(f"ALTER TABLE {files} DROP IF EXISTS {', '.join(gone[low : low + STATEMENT])}")


def drop_event_table(spark: SparkSession, name: str) -> None:
    """Takes the name back; the store stays."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for files in (f"{name}_files", f"{name}_mixed"):
        spark.sql(f"DROP TABLE IF EXISTS {files}")
