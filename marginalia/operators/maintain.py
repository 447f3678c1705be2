"""Keeping an index current: differences of modification times and changes by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """The last row of each key by time; nulls are oldest, equal times go to the larger ``tie``.

    An aggregate of the largest struct, so each task sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys and c not in (time, tie)]
    order = F.struct(F.col(time), *([F.col(tie)] if tie else []), *rest)
    out = df.groupBy(*keys).agg(F.max(order).alias("__last"))
    return out.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in [time, *([tie] if tie else []), *rest]))


def diff(current: DataFrame, previous: DataFrame, key: str = "path", time: str = "update_time") -> DataFrame:
    """``(key, op)``: what turns the previous references into the current files.

    A new file is an ``add``, a gone one a ``delete``, a newer one a ``delete`` and an ``add``. A
    null key isn't compared; a null time on either side is no newer one. Repeated keys count once,
    with their latest time.
    """
    now = current.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(time).alias("__now"), F.lit(True).alias("__is"))
    then = previous.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(time).alias("__then"), F.lit(True).alias("__was"))
    joined = now.join(then, key, "full_outer")
    ops = (
        F.when(F.col("__was").isNull(), F.array(F.lit("add")))
        .when(F.col("__is").isNull(), F.array(F.lit("delete")))
        .when(F.col("__now") > F.col("__then"), F.array(F.lit("delete"), F.lit("add")))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.select(key, F.explode(ops).alias("op"))


def op_name(op: Column) -> Column:
    """``add`` or ``delete`` of an operation however it is spelt; null for others."""
    low = F.lower(F.trim(op))
    return F.when(low.isin("add", "added", "create"), "add").when(low.isin("delete", "del", "deleted", "remove"), "delete")


def expand_events(events: DataFrame) -> DataFrame:
    """``(path, op, op_time)`` of file events ``(event, path, old_path, op_time)``.

    A create adds, a delete deletes, a rename deletes the old path and adds the new one, a change
    deletes and adds.
    """
    def one(path: str, op: str) -> Column:
        return F.struct(F.col(path).alias("path"), F.lit(op).alias("op"))

    event = F.col("event")
    ops = (
        F.when(event == "create", F.array(one("path", "add")))
        .when(event == "delete", F.array(one("path", "delete")))
        .when(event == "rename", F.array(one("old_path", "delete"), one("path", "add")))
        .when(event == "modify", F.array(one("path", "delete"), one("path", "add")))
    )
    return events.select(F.inline(ops), "op_time")


def pending(ops: DataFrame) -> DataFrame:
    """``(vault, path, op, op_time, op_id)``: the last operation of each kind of each path.

    Repeated and late rows don't matter; operations without a path or of an unknown kind are left out.
    """
    known = ops.select("vault", "path", op_name(F.col("op")).alias("op"), "op_time", "op_id").where("path is not null and op is not null")
    return latest(known, ["vault", "path", "op"], "op_time", "op_id")


def net_change(ops: DataFrame) -> DataFrame:
    """``(vault, path, op, op_time)``: what is left to do for each path after all of its operations.

    The later of a path's last add and last delete; of equal times the one with the larger op_id.
    """
    known = ops.select("vault", "path", op_name(F.col("op")).alias("op"), "op_time", "op_id").where("path is not null and op is not null")
    return latest(known, ["vault", "path"], "op_time", "op_id").select("vault", "path", "op", "op_time")


def apply_changes(present: DataFrame, changes: DataFrame) -> DataFrame:
    """``(vault, path)`` present after net changes: without the deleted, with the added."""
    keys = ["vault", "path"]
    gone = changes.where("op = 'delete'").select(*keys)
    new = changes.where("op = 'add'").select(*keys)
    return present.select(*keys).unionByName(new).distinct().join(gone, keys, "left_anti")


def stale_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``(engine, path, state)`` of references: ``missing`` files, ``newer`` files, or ``current`` ones.

    Each (engine, path) once with its latest time; a null time is older than any file.
    """
    last = refs.where("path is not null").groupBy("engine", "path").agg(F.max("update_time").alias("__ref"))
    now = files.where("path is not null").groupBy("path").agg(F.max("update_time").alias("__file"), F.lit(True).alias("__is"))
    state = F.when(F.col("__is").isNull(), "missing").when(F.col("__ref").isNull() | (F.col("__file") > F.col("__ref")), "newer").otherwise("current")
    return last.join(now, "path", "left").select("engine", "path", state.alias("state"))


def last_query(history: DataFrame, order: str = "id", text: str = "query") -> DataFrame:
    """The query of the last row of a history; empty text for an empty history."""
    return history.agg(F.coalesce(F.max_by(text, order), F.lit("")).alias("query"))
