"""``python -m strataweave [--master M] ROOT REPO OPERATION ...``: capture, extraction, publication and the read API from a shell."""

from __future__ import annotations

import argparse
import json


WRITES = ("snapshot", "extract", "run", "watch")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataweave")
    p.add_argument("--master", default="local[*]")
    p.add_argument("root", help="folder of the build store")
    p.add_argument("repo")
    ops = p.add_subparsers(dest="op", required=True)
    for name, *arguments in (
        ("status",), ("search", "text"), ("lookup", "entity"), ("resolve", "text"), ("explain", "entity"), ("neighbors", "entity"), ("path", "start", "goal"),
        ("context", "text"), ("community", "name"), ("report",), ("export", "kind"), ("snapshot", "folder"), ("extract", "folder"), ("run", "folder"), ("watch", "folder"),
    ):
        op = ops.add_parser(name)
        for a in arguments:
            op.add_argument(a)
        if name in ("search", "context", "neighbors", "community"):
            op.add_argument("--limit", type=int, default=20)
        if name in WRITES:
            op.add_argument("--scope", nargs="*")
            op.add_argument("--exclude", nargs="*")
        if name == "path":
            op.add_argument("--hops", type=int, default=4)
        if name == "neighbors":
            op.add_argument("--cursor")
    return p


def run(reader, a: argparse.Namespace) -> str:
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    if a.op in ("report", "export"):
        return reader.report() if a.op == "report" else reader.export(a.kind)
    if a.op == "neighbors":
        out, into, more = reader.neighbors(a.entity, cursor=a.cursor, limit=a.limit)
        return json.dumps({"outgoing": rows(out), "incoming": rows(into), "cursor": more})
    found = {
        "status": lambda: reader.status(),
        "search": lambda: rows(reader.search(a.text, a.limit)),
        "lookup": lambda: rows(reader.lookup(a.entity)),
        "resolve": lambda: rows(reader.resolve(a.text)),
        "explain": lambda: rows(reader.explain(a.entity)),
        "path": lambda: rows(reader.path(a.start, a.goal, a.hops)),
        "context": lambda: rows(reader.context(a.text, limit=a.limit)),
        "community": lambda: rows(reader.community(a.name, a.limit)),
    }[a.op]()
    return json.dumps(found)


def write(spark, a: argparse.Namespace) -> str:
    """The commands that read a folder of sources; ``run`` and ``watch`` publish."""
    from . import build
    from .session import shared_path
    from .sources import snapshot

    if a.op == "run":
        return json.dumps(build.run(spark, a.root, a.repo, a.folder, a.scope, a.exclude))
    if a.op == "watch":
        build.watch(spark, a.root, a.repo, a.folder, shared_path(spark, "watch"), once=False, scope=a.scope, exclude=a.exclude).awaitTermination()
        return json.dumps({})
    files = snapshot.capture(spark, a.folder, a.scope, a.exclude)
    if a.op == "snapshot":
        return json.dumps({"snapshot": snapshot.snapshot_id(files, a.repo, ",".join(a.scope or [])).first().snapshot_id, "files": files.count()})
    made = build.extraction(files.filter("text IS NOT NULL"), "build")
    counts = {r["kind"]: r["count"] for r in made.nodes.groupBy("kind").count().collect()}
    return json.dumps(counts | {"relations": made.edges.count(), "coverage": {r["status"]: r["count"] for r in made.coverage.groupBy("status").count().collect()}})


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from .reader import GraphReader

    spark = SparkSession.builder.master(a.master).config("spark.ui.enabled", "false").getOrCreate()
    print(write(spark, a) if a.op in WRITES else run(GraphReader.pin(spark, a.root, a.repo), a))


if __name__ == "__main__":
    main()
