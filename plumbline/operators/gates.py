"""Which folder a path belongs to, and whether a hook may index a file, and under which path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roots_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` (with ``path``) with the ``root`` that each lies in or is, the longest if several; those in none go.

    A path is split into itself and the folders above it, and these meet the ``roots`` (root) by a hash join. A path has as many
    as it has slashes, so the join grows with the paths alone, however many roots there are. A root's last slash doesn't count.
    """
    known = roots.select("root", F.when(F.col("root") == "/", "").otherwise(F.rtrim("root", F.lit("/"))).alias("_above")).where("root IS NOT NULL")
    known = known.groupBy("_above").agg(F.min("root").alias("root"))
    pieces = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))
    keyed = paths.where("path IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    met = keyed.select("_row", *paths.columns, F.explode(above).alias("_above")).join(known, "_above")
    best = F.max_by(F.struct(*paths.columns, "root"), F.length("_above")).alias("best")
    return met.groupBy("_row").agg(best).select("best.*")


def forms(target: str, cwd: str | None) -> list[str]:
    """The forms under which an index may know a path: as it is, and from ``cwd``."""
    target = target.replace("\\", "/").removeprefix("./")
    below = (cwd or "").rstrip("/") + "/"
    return [target, target[len(below) :]] if target.startswith("/") and cwd and target.startswith(below) else [target]


def fits(path: Column, form: str) -> Column:
    """Whether ``form`` lies in the folder that an index's ``path`` speaks for.

    Absolute paths speak for their own folder, but for the topmost, relative ones for their topmost folder, those without a
    folder for themselves alone.
    """
    parent = F.regexp_replace(path, "/[^/]*$", "")
    own = (parent != "") & F.startswith(F.lit(form), F.concat(parent, F.lit("/")))
    top = F.startswith(F.lit(form), F.concat(F.substring_index(path, "/", 1), F.lit("/")))
    if form.startswith("/"):
        return F.startswith(path, F.lit("/")) & own
    return ~F.startswith(path, F.lit("/")) & F.when(F.contains(path, F.lit("/")), top).otherwise(path == form)


def under_indexed_root(target: str, cwd: str | None, paths: DataFrame) -> str | None:
    """The form of ``target`` under which an index with those ``paths`` (path) would know it; None if it lies outside."""
    for form in forms(target, cwd):
        if not paths.where(fits(F.col("path"), form)).isEmpty():
            return form
    return None
