"""Declarations, calls, heritage and imports of Python files, with a coverage row for each file, and what joins do with such facts.

A file that doesn't parse yields no facts. ``declarations`` has Rust, TypeScript and Nix.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT = "path string, fact string, name string, parent string, start_line int, end_line int, local boolean"


def python_facts(path: str, text: str) -> list[tuple]:
    out: list[tuple] = []

    def walk(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                here = f"{parent}.{child.name}" if parent else child.name
                out.append((path, "declaration", here, parent, child.lineno, child.end_lineno, False))
                for base in getattr(child, "bases", ()):
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        out.append((path, "inherits", ast.unparse(base).split(".")[-1], here, base.lineno, base.end_lineno, False))
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                f = child.func
                local = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self"
                out.append((path, "call", f.id if isinstance(f, ast.Name) else f.attr, parent, child.lineno, child.end_lineno, local))
            elif isinstance(child, ast.Import):
                out.extend((path, "import", a.name, parent, child.lineno, child.end_lineno, False) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append((path, "import", "." * child.level + (child.module or ""), parent, child.lineno, child.end_lineno, False))
            walk(child, here)

    walk(ast.parse(text), None)
    return out


def facts_of(path: str, text: str) -> tuple[list[tuple], str]:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "py":
        try:
            return python_facts(path, text), "parsed"
        except (SyntaxError, ValueError, RecursionError):
            return [], "parse_error"
    return [], "unsupported"


def facts(files: DataFrame) -> DataFrame:
    """Facts of every file (path, text), each file's coverage among them as fact ``coverage``."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in FACT.split(", ")]
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                found, status = facts_of(path, text or "")
                rows += [*found, (path, "coverage", status, None, 0, 0, False)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, FACT)


def resolved_calls(found: DataFrame) -> DataFrame:
    """(path, caller, callee, how): calls whose name one declaration of the file has, or one of all files."""
    last = F.element_at(F.split("name", r"\."), -1)
    defs = found.filter("fact = 'declaration'").select("path", "name", last.alias("short"))
    near = defs.groupBy("path", "short").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("near")).filter("n = 1").drop("n")
    wide = defs.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws("::", "path", "name")).alias("wide")).filter("n = 1").drop("n")
    calls = found.filter("fact = 'call'").select("path", F.col("parent").alias("caller"), F.col("name").alias("short"), "local")
    joined = calls.join(near, ["path", "short"], "left").join(wide, "short", "left")
    target = F.when(F.col("near").isNotNull(), F.concat_ws("::", "path", "near")).otherwise(F.when(~F.col("local"), F.col("wide")))
    how = F.when(F.col("near").isNotNull(), "file").otherwise("global")
    return joined.select("path", "caller", target.alias("callee"), how.alias("how")).filter("callee IS NOT NULL").distinct()


def annotated(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Comment markers (path, line, note) with the declaration that follows on the next line, else the innermost around them."""
    d = found.filter("fact = 'declaration'").select("path", "name", "start_line", "end_line")
    near = notes.join(d, "path", "left").filter("name IS NULL OR start_line = line + 1 OR (start_line <= line AND end_line >= line)")
    best = Window.partitionBy("path", "line", "note").orderBy((F.col("start_line") == F.col("line") + 1).desc(), F.desc("start_line"))
    first = near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("path", "line", "note", "name")
    return notes.join(first, ["path", "line", "note"], "left").select("path", "line", "note", F.coalesce("name", "path").alias("target"))
