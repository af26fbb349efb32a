"""Session databases: a Python data source over SQLite files, read in row-id ranges with filters pushed down, and their catalog.

A path is one file or a folder of ``*.db`` files. Files are cut by their size, and a task asks the file itself for the
row ids of its share, so the driver opens none. Comparisons with a constant, ``IN`` and null tests
become part of the SQL where the session allows it (``register`` turns it on). Rows come as Arrow batches.

The table ``__catalog__`` has what a database declares: tables, views, columns, primary keys, unique and other
indexes, foreign keys and triggers. ``export_sessions`` writes such files in parallel. Files must lie where every executor can open them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CATALOG = "__catalog__"
CATALOG_SCHEMA = "file string, key string, kind string, name string, parent string, detail string"
#: Bytes of a file for each of its splits, and rows of a batch.
SPLIT_BYTES, ROWS = 64 << 20, 4096
COMPARISONS = {"EqualTo": "=", "EqualNullSafe": "IS", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


class Split(InputPartition):
    def __init__(self, file: str, number: int, of: int):
        self.file, self.number, self.of = file, number, of


def plain(name: str) -> str:
    if not name.replace("_", "").isalnum():
        raise ValueError(f"not a name: {name!r}")
    return name


def catalog(file: str) -> Iterator[tuple]:
    """Rows of ``CATALOG_SCHEMA``; keys are unique within a file."""
    import sqlite3

    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        declared = db.execute("SELECT type, name, tbl_name, sql FROM sqlite_master WHERE name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall()
        for kind, name, home, sql in declared:
            if kind in ("table", "view"):
                yield file, f"{kind}:{name}", kind, name, None, None
                for _, column, typ, not_null, default, primary in db.execute(f'PRAGMA table_info("{name}")'):
                    told = " ".join(x for x in (typ, "NOT NULL" if not_null else "", f"DEFAULT {default}" if default is not None else "") if x)
                    yield file, f"column:{name}.{column}", "column", column, f"{kind}:{name}", told
                    if primary:
                        yield file, f"primary:{name}.{column}", "primary", column, f"{kind}:{name}", str(primary)
                for _, index, unique, _, _ in db.execute(f'PRAGMA index_list("{name}")'):
                    columns = ",".join(r[2] or "" for r in db.execute(f'PRAGMA index_info("{index}")'))
                    yield file, f"index:{index}", "unique" if unique else "index", index, f"{kind}:{name}", columns
                for number, place, target, source, to, *_ in db.execute(f'PRAGMA foreign_key_list("{name}")'):
                    yield file, f"foreign:{name}.{number}.{place}", "foreign", source, f"{kind}:{name}", f"{target}({to})"
            elif kind == "trigger":
                yield file, f"trigger:{name}", "trigger", name, f"table:{home}", sql


class Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options
        self.clauses: list[tuple[str, list]] = []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            kind = type(f).__name__
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if kind == "In" else [getattr(f, "value", None)]
            simple = all(isinstance(v, (int, float, str)) for v in values)
            if name is None or self.options.get("table") == CATALOG:
                yield f
            elif kind in COMPARISONS and simple:
                self.clauses.append((f'"{plain(name)}" {COMPARISONS[kind]} ?', values))
            elif kind == "In" and simple and len(values) <= 500:
                self.clauses.append((f'"{plain(name)}" IN ({", ".join("?" * len(values))})', values))
            elif kind in ("IsNull", "IsNotNull"):
                self.clauses.append((f'"{plain(name)}" IS {"NOT " * (kind == "IsNotNull")}NULL', []))
            else:
                yield f

    def partitions(self) -> list[Split]:
        path = self.options["path"].removeprefix("file://")
        files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".db")] if os.path.isdir(path) else [path]
        size = int(self.options.get("splitbytes", SPLIT_BYTES))
        out = []
        for file in files:
            n = 1 if self.options.get("table") == CATALOG else max(1, -(-os.path.getsize(file) // size))
            out += [Split(file, i, n) for i in range(n)]
        return out or [Split("", 0, 0)]

    def read(self, part: Split):
        import sqlite3

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.of:
            return
        kinds = to_arrow_schema(self.schema)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
        if self.options["table"] == CATALOG:
            places = [CATALOG_SCHEMA.replace(" string", "").split(", ").index(f.name) for f in self.schema.fields]
            rows = [tuple(r[i] for i in places) for r in catalog(part.file)]
            if rows:
                yield batch(rows)
            return
        table = plain(self.options["table"])
        names = ", ".join(f'"{plain(f.name)}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{part.file}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid),0), coalesce(max(rowid),-1) FROM "{table}"').fetchone()
            step = -(-(high - low + 1) // part.of)
            where = " AND ".join(["rowid >= ?", "rowid < ?", *(c for c, _ in self.clauses)])
            values = [low + part.number * step, min(low + (part.number + 1) * step, high + 1), *(v for _, vs in self.clauses for v in vs)]
            found = db.execute(f'SELECT {names} FROM "{table}" WHERE {where} ORDER BY rowid', values)
            while rows := found.fetchmany(ROWS):
                yield batch(rows)


class SqliteSource(DataSource):
    """``register(spark)``, then ``read.format("sqlite").schema(...).option("table", ...).load(path)``; the catalog has its own schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        if self.options.get("table") == CATALOG:
            return CATALOG_SCHEMA
        raise ValueError("a schema is needed")

    def reader(self, schema) -> Reader:
        return Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    if hasattr(ds, "EqualTo"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def export_sessions(messages: DataFrame, folder: str, files: int) -> DataFrame:
    """Writes messages (session, turn, role, text) as session databases, a session whole in one of ``files``; (file, n) of each.

    Each is written beside its place and renamed, so a task that runs again replaces it by the same.
    """
    folder = folder.removeprefix("file://")

    def run(batches):
        import sqlite3
        import uuid

        import pyarrow as pa

        db = now = beside = None
        n = 0

        def close():
            db.execute("INSERT INTO session SELECT session, count(*) FROM session_message GROUP BY 1")
            db.commit()
            db.close()
            os.replace(beside, f"{folder}/{now}.db")
            return pa.RecordBatch.from_arrays([pa.array([f"{now}.db"]), pa.array([n])], names=["file", "n"])

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if db:
                        yield close()
                    now, n, beside = part, 0, f"{folder}/.{part}-{uuid.uuid4().hex}"
                    db = sqlite3.connect(beside)
                    db.executescript(
                        "CREATE TABLE session (id TEXT PRIMARY KEY, n INTEGER NOT NULL DEFAULT 0);"
                        "CREATE TABLE session_message (session TEXT NOT NULL REFERENCES session(id), turn INTEGER, role TEXT, text TEXT);"
                        "CREATE INDEX message_role ON session_message (role);"
                        "CREATE VIEW users AS SELECT * FROM session_message WHERE role = 'user';"
                        "CREATE TRIGGER counted AFTER DELETE ON session_message BEGIN UPDATE session SET n = n - 1 WHERE id = OLD.session; END;"
                    )
                db.execute("INSERT INTO session_message VALUES (?, ?, ?, ?)", row)
                n += 1
        if db:
            yield close()

    part = F.pmod(F.xxhash64("session"), F.lit(files)).cast("int").alias("part")
    dealt = messages.select(part, F.col("session").cast("string"), F.col("turn").cast("long"), "role", "text").repartition("part").sortWithinPartitions("part", "session", "turn")
    return dealt.mapInArrow(run, "file string, n long")
