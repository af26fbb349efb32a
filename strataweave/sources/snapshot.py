"""Snapshots of file trees, record files and diffs as DataFrames.

Contents are read by Spark's own sources, so a tree may lie in any store that Spark reaches;
listings drop the content column, which the source then never loads.
"""

from __future__ import annotations

import re
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import digests

SKIPPED = (".git", "target", "node_modules")
MOST_FILES, MOST_BYTES = 128, 16 << 20


def validate_scope(path: str) -> str:
    """A relative path below the root; raises on anything else."""
    if not path or path.startswith(("/", "!")) or "\\" in path or ".." in path.split("/"):
        raise ValueError(f"not a path below the root: {path!r}")
    return path.strip("/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of every file, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(root.split(":")[-1].strip("/")) + "/"), F.lit(""))
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.col("path").alias("uri"))


def kept(path: Column, scope: list[str], exclude: list[str]) -> Column:
    under = lambda roots: F.exists(F.array(*[F.lit(validate_scope(r)) for r in roots]), lambda r: (path == r) | path.startswith(F.concat(r, F.lit("/"))))
    ok = ~F.exists(F.split(path, "/"), lambda part: part.isin(*SKIPPED))
    if scope:
        ok = ok & under(scope)
    return ok & ~under(exclude) if exclude else ok


def ignored(paths: list[str], rules: list[str]) -> set[str]:
    """The paths that ignore rules hide: globs, ``dir/`` prefixes, ``!`` brings back, the last rule wins."""
    out = set()
    for p in paths:
        hidden = False
        for rule in (r.strip() for r in rules):
            if not rule or rule.startswith("#"):
                continue
            back, rule = rule.startswith("!"), rule.lstrip("!")
            plain = rule.strip("/")
            parts = p.split("/")
            hit = fnmatch(p, plain) or any(fnmatch("/".join(parts[:k]), plain) for k in range(1, len(parts)))
            if "/" not in plain:
                hit = hit or any(fnmatch(x, plain) for x in (parts[:-1] if rule.endswith("/") else parts))
            if hit:
                hidden = not back
        if hidden:
            out.add(p)
    return out


def capture(spark: SparkSession, root: str, scope: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, sha256, bytes, text) of every UTF-8 file in scope; text is null where it isn't UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(root.split(":")[-1].strip("/")) + "/"), F.lit(""))
    rows = files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")
    valid = F.encode(F.col("content").cast("string"), "UTF-8") == F.col("content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")) & valid, F.col("content").cast("string"))
    return rows.filter(kept(F.col("path"), scope or [], exclude or [])).select("path", "sha256", "bytes", text.alias("text"))


def snapshot_id(files: DataFrame, repo: str, scope: str = "") -> DataFrame:
    whole = digests(files, [], ["path"], F.concat("path", F.lit(":"), "sha256"))
    return whole.select(F.concat(F.lit("snap:"), F.substring(F.sha2(F.concat(F.lit(f"{repo}\0{scope}\0"), "digest"), 256), 1, 12)).alias("snapshot_id"))


def inventory(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row (files, bytes, complete, stopped_by) of a listing (path, bytes), contents unread.

    Within the budgets all is counted; else what fits of it in path order, and which budget stopped it.
    """
    from pyspark.sql import Window

    whole = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size")).first()
    if whole.n <= most_files and whole.size <= most_bytes:
        return files.sparkSession.createDataFrame([(whole.n, whole.size, True, None)], "files long, bytes long, complete boolean, stopped_by string")
    first = files.select("path", "bytes").orderBy("path").limit(most_files + 1)  # rows that a window may order in one task
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = first.withColumns({"used": F.sum("bytes").over(order), "i": F.row_number().over(Window.orderBy("path"))})
    kept = kept.filter((F.col("used") <= most_bytes) & (F.col("i") <= most_files))
    counted = kept.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return counted.select("files", "bytes", F.lit(False).alias("complete"), F.when(F.col("files") == most_files, "files").otherwise("bytes").alias("stopped_by"))


def exact_set(files: DataFrame, paths: list[str]) -> DataFrame:
    """Just these files; raises when one is missing or they exceed the bounds."""
    if not 1 <= len(paths) <= MOST_FILES:
        raise ValueError(f"1 to {MOST_FILES} paths")
    found = files.filter(F.col("path").isin(*map(validate_scope, paths)))
    seen = found.agg(F.count_distinct("path").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    if seen.n != len(set(paths)) or seen.b > MOST_BYTES:
        raise ValueError("a path is missing or the set is too large")
    return found


def fingerprint(files: DataFrame) -> DataFrame:
    """A cheap change detector over path, size and time."""
    return digests(files, [], ["path"], F.concat_ws("|", "path", "bytes", "modified")).select(F.col("digest").alias("fingerprint"))


def jsonl_records(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed records of a text column ``value``; raises on a repeated id."""
    rows = lines.filter("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate record id {twice[0].id}")
    return rows


def receipt_generation(name: Column) -> Column:
    """Generation of a receipt file: ``id.json`` is 1, ``id.N.json`` is N from 2 on, anything else null."""
    n = F.regexp_extract(name, r"^[^.]+\.([1-9][0-9]*)\.json$", 1)
    return F.when(name.rlike(r"^[^.]+\.json$"), 1).when((n != "") & (n != "1"), n.try_cast("int"))


def receipts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Receipts below a folder of JSON files: ``id``, ``generation``, ``newest`` and their fields, which are named in ``schema``.

    Files that aren't named like receipts are left out; of several generations of an id all are listed.
    """
    from pyspark.sql import Window

    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(root)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    found = rows.select(F.regexp_extract(name, r"^([^.]+)", 1).alias("id"), receipt_generation(name).alias("generation"), F.struct(*rows.columns).alias("r"))
    newest = F.col("generation") == F.max("generation").over(Window.partitionBy("id"))
    return found.filter("generation IS NOT NULL").withColumn("newest", newest).select("id", "generation", "newest", *(F.col("r")[c].alias(c) for c in rows.columns if c != "id"))


def parse_diff(lines: DataFrame, diff: list[str]) -> DataFrame:
    """(file, h_start, h_end): old-side ranges of the hunks of unified diffs (the columns ``diff``, ``pos``, ``line``).

    An added file (``--- /dev/null``) goes by its new path. The order of lines matters within a diff, so each
    is a partition of the window.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*diff).orderBy("pos")
    old, new = (F.regexp_extract("line", rf"^{mark} (?:{side}/)?([^\t]+)", 1) for mark, side in ((r"---", "a"), (r"\+\+\+", "b")))
    named = F.when(F.col("line").startswith("--- ") & (old != "/dev/null"), old).when(F.col("line").startswith("+++ ") & (F.lag("line").over(order) == "--- /dev/null"), new)
    running = F.last(named, ignorenulls=True).over(order)
    hunk = r"^@@ -([0-9]+)(?:,([0-9]+))? "
    start = F.regexp_extract("line", hunk, 1).try_cast("int")
    count = F.regexp_extract("line", hunk, 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("int"))
    found = lines.withColumn("file", running).filter(F.col("line").startswith("@@ "))
    return found.select("file", start.alias("h_start"), (start + F.greatest(n - 1, F.lit(0))).alias("h_end"))


def ledger_tail(rows: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Rows of the last minutes before the newest one."""
    last = rows.agg(F.max(ts).alias("_last"))
    return rows.join(F.broadcast(last), F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {minutes} MINUTES")).drop("_last")


def catalog_records(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str | None]]:
    """(key, kind, name, parent) of tables and their columns, by key."""
    out = []
    for name, df in tables.items():
        out.append((f"table:{name}", "table", name, None))
        out += [(f"column:{name}.{f.name}", "column", f.name, f"table:{name}") for f in df.schema.fields]
    return sorted(out)


def pg_catalog_records(pg: dict[str, DataFrame], schema: str) -> DataFrame:
    """(key, kind, name, parent, target, details) of a schema, from frames of the public system catalog, as a JDBC read gives them.

    ``pg`` has namespace (oid, nspname), class (oid, relname, relnamespace, relkind), attribute (attrelid, attnum, attname, atttypid,
    attnotnull, attisdropped), attrdef (adrelid, adnum, adbin), constraint (oid, conname, conrelid, contype, confrelid), index
    (indexrelid, indrelid, indisunique, indisprimary) and proc (oid, proname, pronamespace, prokind). Columns come with their defaults;
    dropped ones and system columns (numbers below 1) don't; a foreign key's target may lie in another schema and is named even so.
    """
    own = pg["namespace"].filter(F.col("nspname") == schema).select(F.col("oid").alias("relnamespace"))
    #: Relation kinds of the catalog.
    kinds = {"r": "table", "p": "table", "v": "view", "m": "materialized_view", "f": "foreign_table"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("relkind"))
    relations = pg["class"].filter(F.col("relkind").isin(*kinds)).join(own, "relnamespace").select(F.col("oid").alias("relation"), "relname", kind.alias("relkind"))
    key = lambda prefix, *ids: F.concat_ws(":", F.lit(prefix), *ids)
    none = F.lit(None).cast("string")
    row = lambda k, word, name, parent, target, details: [k.alias("key"), word.alias("kind"), name.alias("name"), parent.alias("parent"), target.alias("target"), details.alias("details")]
    home = key("relation", "relation")
    out = relations.select(*row(home, F.col("relkind"), F.col("relname"), none, none, none))
    attributes = pg["attribute"].filter("attnum > 0 AND NOT attisdropped").join(relations, F.col("attrelid") == F.col("relation"))
    attributes = attributes.join(pg["attrdef"], (F.col("adrelid") == F.col("attrelid")) & (F.col("adnum") == F.col("attnum")), "left")
    told = F.to_json(F.struct(F.col("attnum").alias("position"), F.col("atttypid").alias("type"), (~F.col("attnotnull")).alias("nullable"), F.col("adbin").alias("default")))
    out = out.unionByName(attributes.select(*row(key("column", "relation", "attnum"), F.lit("column"), F.col("attname"), home, none, told)))
    constraints = pg["constraint"].join(relations, F.col("conrelid") == F.col("relation"))
    target = F.when(F.col("contype") == "f", key("relation", "confrelid"))
    constraints = constraints.join(pg["class"].select(F.col("oid").alias("confrelid"), F.col("relname").alias("target_name")), "confrelid", "left")
    told = F.to_json(F.struct(F.col("contype").alias("type"), "target_name"))
    out = out.unionByName(constraints.select(*row(key("constraint", "oid"), F.lit("constraint"), F.col("conname"), home, target, told)))
    indexes = pg["index"].join(relations, F.col("indrelid") == F.col("relation")).join(pg["class"].select(F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name")), "indexrelid")
    told = F.to_json(F.struct(F.col("indisunique").alias("unique"), F.col("indisprimary").alias("primary")))
    out = out.unionByName(indexes.select(*row(key("index", "indexrelid"), F.lit("index"), F.col("index_name"), home, none, told)))
    routines = pg["proc"].join(own, F.col("pronamespace") == F.col("relnamespace"))
    return out.unionByName(routines.select(*row(key("routine", "oid"), F.lit("routine"), F.col("proname"), none, none, F.to_json(F.struct(F.col("prokind").alias("kind"))))))
