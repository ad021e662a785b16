"""Changes to versioned records as joins and folds over an event log; nothing is updated in place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.lineage import cut
from chronoloom.operators.neighbours import with_neighbours, with_running_sum


def versioned_update(base: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base (keys, version, value) after changes (keys, expected, value): (keys, version, value, outcome).

    A change applies if it expects the version that is there, and raises it by one; of several for a key the first by value does.
    outcome: applied, stale (the change expected another version) or kept (no change).
    """
    fits = F.col("expected") == F.col("version")
    asked = base.join(changes.withColumnRenamed(value, "asked__"), keys, "left")
    one = asked.groupBy(*keys, "version", value).agg(F.min(F.when(fits, F.col("asked__"))).alias("new__"), F.count("expected").alias("asks__"))
    applied = F.col("new__").isNotNull()
    outcome = F.when(applied, "applied").when(F.col("asks__") > 0, "stale").otherwise("kept")
    return one.select(*keys, (F.col("version") + applied.cast("int")).alias("version"), F.coalesce("new__", value).alias(value), outcome.alias("outcome"))


def undo_redo(events: DataFrame, key: str, order: str, action: str, value: str) -> DataFrame:
    """(key, value, edits, undone): each key's value after its log of `edit`, `undo` and `redo` in order; an edit clears what could be redone.

    Undo without an edit, and redo without an undo, do nothing. A key's log is folded in one task in batches, with the stack as state, as each
    step depends on all before it.
    """

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        log = log.sort_values(order)
        done: list = []
        gone: list = []
        for what, to in zip(log[action], log[value], strict=True):
            if what == "edit":
                done.append(to)
                gone.clear()
            elif what == "undo" and done:
                gone.append(done.pop())
            elif what == "redo" and gone:
                done.append(gone.pop())
        return pd.DataFrame({key: log[key].iloc[:1], value: [done[-1] if done else None], "edits": [len(done)], "undone": [len(gone)]})

    kinds = dict(events.dtypes)
    return events.select(key, order, action, value).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {value} {kinds[value]}, edits long, undone long")


def submit_once(stored: DataFrame, submitted: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of submitted whose key isn't stored, the first by order of those that share a key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return submitted.join(stored.select(key).distinct(), key, "left_anti").withColumn("nth__", first).filter("nth__ = 1").drop("nth__")


def cascade(parents: DataFrame, doomed: Column, children: DataFrame, key: str, guards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children that stay when doomed parents go with their children, unless a guard (key) refers to the parent."""
    gone = parents.filter(doomed).join(guards.select(key).distinct(), key, "left_anti").select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def replace_keys(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with all rows of the keys that new has replaced by new's rows."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_adjacent(spans: DataFrame, keys: list[str], label: str, slice_width: int) -> DataFrame:
    """(keys, label, start, end, parts): rows that follow one another without a gap and share a label, as one; parts counts them.

    A row begins a run unless the row before it, by the start, ends where it starts and has its label. Runs are numbered by
    sums over slices of the timeline.
    """
    part = F.floor(F.col("start") / slice_width)
    seen = with_neighbours(spans.select(*keys, label, "start", "end"), keys, ["start", "end"], ["start", "end", label], part)
    new = ~F.coalesce((F.col("before.end") == F.col("start")) & F.col(f"before.{label}").eqNullSafe(F.col(label)), F.lit(False))
    marked = cut(seen.select(*keys, label, "start", "end", new.cast("long").alias("new__")))  # read twice
    numbered = with_running_sum(marked, keys, ["start", "end"], "new__", part, "run__")
    return numbered.groupBy(*keys, "run__").agg(F.first(label).alias(label), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("run__")
