"""Reports of a run as Markdown and text; only small aggregates and bounded lists come to the driver."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, functions as F

from gneiss.functions.scalars import format_count, format_size


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    rows = df.limit(limit).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |\n" for r in rows)


def summary(results: DataFrame) -> DataFrame:
    """Counts and bytes by status, the most frequent first."""
    found = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_written").alias("b"))
    return found.orderBy(F.desc("n"), "status").select("status", format_count(F.col("n")).alias("files"), format_size(F.col("b")).alias("size"))


def write_reports(results: DataFrame, folder: str, collisions: DataFrame | None = None, truncated: DataFrame | None = None, limit: int = 1000) -> None:
    """recovery_summary.md, unrecovered_files.md and skipped_files.md; lists stop at ``limit`` rows and say so."""
    os.makedirs(folder, exist_ok=True)
    parts = ["# Recovery summary\n", markdown_table(summary(results))]
    for title, df in (("Path collisions", collisions), ("Possibly truncated files", truncated)):
        if df is not None and (n := df.count()):
            parts += [f"\n## {title}\n", markdown_table(df.orderBy(*df.columns), limit), f"\n{n - limit} more\n" if n > limit else ""]
    _replace(f"{folder}/recovery_summary.md", "\n".join(parts))
    skipped = results.where(F.col("status").isin("below minimum size", "above maximum size", "empty orphan"))
    failed = results.where(~F.col("status").isin("ok", "link", "below minimum size", "above maximum size", "empty orphan"))
    for name, title, df in (("unrecovered_files.md", "Unrecovered files", failed), ("skipped_files.md", "Skipped files", skipped)):
        n = df.count()
        more = f"\n{n - limit} more\n" if n > limit else ""
        _replace(f"{folder}/{name}", f"# {title}\n\n{n} files\n\n" + markdown_table(df.orderBy("path").select("path", "inode_id", "status"), limit) + more)


def write_file_list(files: DataFrame, path: str) -> None:
    """One line per file: its size, right-aligned in twelve places, and its path."""
    files.orderBy("path").select(F.concat(F.lpad(F.coalesce(F.col("size"), F.lit(0)).cast("string"), 12, " "), F.lit("  "), "path")).write.mode("overwrite").text(path)


def archive_run(folder: str, names: list[str]) -> str | None:
    """Move the outputs of an earlier run to ``run_N`` beside them; the folder's name, or None if there were none."""
    have = [n for n in names if os.path.exists(os.path.join(folder, n))]
    if not have:
        return None
    k = 1
    while os.path.exists(os.path.join(folder, f"run_{k}")):
        k += 1
    target = os.path.join(folder, f"run_{k}")
    os.makedirs(target)
    for n in have:
        shutil.move(os.path.join(folder, n), os.path.join(target, n))
    return target


def _replace(path: str, text: str) -> None:
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
