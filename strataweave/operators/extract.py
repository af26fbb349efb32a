"""Entities and references out of source texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of headings, links and inline code in Markdown, and of markers in comments.
HEADING = r"(?m)^(#{1,6})[ \t]+(.+)$"
LINK = r"\[([^\]]+)\]\(([^)\s]+)\)"
CODE = r"`([^`\n]+)`"
MARKERS = "NOTE WHY TODO FIXME HACK SAFETY XXX".split()
SUPPORTED = "rs ts tsx js jsx mts cts nix py md markdown mdx txt rst adoc json".split()
BINARY = "pdf png jpg jpeg gif webp docx xlsx pptx zip mp3 mp4".split()

SPAN = "file string, start_line int, start_col int, end_line int, end_col int, byte_start int, byte_end int"
ENTITY = f"file string, kind string, name string, qualified_name string, span struct<{', '.join(x.replace(' ', ': ', 1) for x in SPAN.split(', '))}>"


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(2))


def inline_code(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(1))


def rationale(text: Column) -> Column:
    """Marked comments: the marker and what follows on its line."""
    pattern = r"(?m)^\s*(?://|#|--|\*)\s*((?:" + "|".join(MARKERS) + r")\b:?.*)$"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def supported(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*SUPPORTED) & path.contains(".")


def unsupported(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*BINARY) & path.contains(".")


def slices(rows: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, start, end, part): fixed-width slices of a text by characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    cut = rows.select(key, F.col(text).alias("_t"), F.explode(starts).alias("start"))
    end = F.least(F.col("start") + width, F.length("_t"))
    return cut.select(key, "start", end.alias("end"), F.substring(F.col("_t"), F.col("start") + 1, F.lit(width)).alias("part"))


def line_col(text: str, offset: int) -> tuple[int, int]:
    """1-based line and column (in characters) of a character offset."""
    return text.count("\n", 0, offset) + 1, offset - (text.rfind("\n", 0, offset) + 1) + 1


def span_of(path: str, text: str, a: int, z: int) -> tuple:
    (l1, c1), (l2, c2) = line_col(text, a), line_col(text, z)
    return path, l1, c1, l2, c2, len(text[:a].encode()), len(text[:z].encode())


_DEFS = {
    "py": re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)"),
    "rs": re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?(?:fn|struct|enum|trait|mod|type|const)[ \t]+(\w+)"),
    "ts": re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|class|interface|type|enum|const)[ \t]+(\w+)"),
}
_IMPORTS = {
    "py": re.compile(r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))"),
    "rs": re.compile(r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)"),
    "ts": re.compile(r"(?m)^[ \t]*import\b[^'\"\n]*['\"]([^'\"]+)['\"]"),
}
_SAME = {"tsx": "ts", "js": "ts", "jsx": "ts", "mts": "ts", "cts": "ts"}


def entities_of(path: str, text: str) -> list[tuple]:
    """Entities of one file: the file, definitions and imports, or Markdown headings, links and code."""
    ext = path.rsplit(".", 1)[-1].lower()
    ext = _SAME.get(ext, ext)
    found = [(path, "file", path, path, (path, 1, 1, 1, 1, 0, 0))]

    def add(kind: str, m: re.Match, group: int) -> None:
        name = m[group].strip()
        found.append((path, kind, name, f"{path}::{name}", span_of(path, text, *m.span(group))))

    if ext in _DEFS:
        for m in _DEFS[ext].finditer(text):
            add("definition", m, 1)
        for m in _IMPORTS[ext].finditer(text):
            add("import", m, m.lastindex)
    elif ext in ("md", "markdown", "mdx"):
        for kind, pattern, group in (("heading", HEADING, 2), ("link", LINK, 2), ("code_mention", CODE, 1)):
            for m in re.finditer(pattern, text):
                add(kind, m, group)
    else:
        found.append((path, "symbol", path.rsplit("/", 1)[-1], f"{path}::text", (path, 1, 1, 1, 1, 0, 0)))
    return found


def extract(files: DataFrame) -> DataFrame:
    """Entities with exact spans of every file (path, text); offsets need Python, so one Arrow pass."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [e for path, text in zip(pdf["path"], pdf["text"]) for e in entities_of(path, text or "")]
            spans = [dict(zip(("file", "start_line", "start_col", "end_line", "end_col", "byte_start", "byte_end"), r[4])) for r in rows]
            yield pd.DataFrame({"file": [r[0] for r in rows], "kind": [r[1] for r in rows], "name": [r[2] for r in rows], "qualified_name": [r[3] for r in rows], "span": spans})

    return files.select("path", "text").mapInPandas(run, ENTITY)


def item_text(text: str, start: int, end: int, most: int = 1024) -> str | None:
    """The text from ``start`` to ``end`` with the comment, attribute and decorator lines right above, trimmed, within ``most`` bytes."""
    lines = text[:start].split("\n")
    head = lines.pop()
    above = 0
    while above < len(lines) and lines[-1 - above].lstrip().startswith(("//", "/*", "*", "#", "@")):
        above += 1
    whole = "\n".join([*lines[len(lines) - above :], head]) + text[start : max(start, end)]
    return whole.strip().encode()[:most].decode("utf-8", "ignore").rstrip() or None


def embedding_input(kind: Column, qualified_name: Column, text: Column) -> Column:
    """What stands for an entity in vector space: name and text of definitions and headings, nothing for others."""
    return F.when(kind.isin("definition", "heading") & text.isNotNull(), F.concat_ws("\n", qualified_name, text))


def local_references(entities: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """(file, name, mentions): definitions that their own file names again, mentions counted up to ``most`` + 1.

    Words of a file are counted once and joined to its definitions.
    """
    words = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("name"))
    uses = words.groupBy("file", "name").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("mentions"))
    own = entities.filter("kind = 'definition'").select("file", "name").distinct()
    return own.join(uses, ["file", "name"]).filter("mentions > 1")


def citations(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """(from_id, to_id, cite): ADR and RFC numbers cited, where one document has the number and isn't the one that cites.

    ``texts``: id, text; ``documents``: id, cite (like ``ADR-7``).
    """
    found = F.regexp_extract_all(F.upper("text"), F.lit(r"\b((?:ADR|RFC)[- ]?0*[0-9]+)\b"), F.lit(1))
    plain = F.transform(found, lambda c: F.regexp_replace(c, r"^(ADR|RFC)[- ]?0*([0-9]+)$", "$1-$2"))
    cited = texts.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(plain)).alias("cite"))
    known = documents.groupBy("cite").agg(F.min("id").alias("to_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return cited.join(known, "cite").filter("from_id <> to_id").select("from_id", "to_id", "cite")


def import_targets(imports: DataFrame, definitions: DataFrame, most: int = 200) -> DataFrame:
    """(import_id, def_id): an import's last segment against definitions of that name in other files, each name's first ``most`` by id."""
    from pyspark.sql import Window

    last = F.regexp_extract("target", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("def_id"))
    first = definitions.withColumn("_r", rank).filter(F.col("_r") <= most).select("def_id", "name", F.col("file").alias("there"))
    return imports.withColumn("name", last).join(first, "name").filter("file <> there").select("import_id", "def_id")


def adjacent_definitions(definitions: DataFrame, most: int = 25) -> DataFrame:
    """(file, a, b): each definition with the next one of its file, the first ``most`` pairs."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("start", "def_id")
    paired = definitions.select("file", F.col("def_id").alias("a"), F.lead("def_id").over(order).alias("b"), F.row_number().over(order).alias("_n"))
    return paired.filter((F.col("_n") <= most) & F.col("b").isNotNull()).drop("_n")


def resolved_path(base: Column, target: Column) -> Column:
    """A relative import's path from the file that has it, normalised; null where it leaves the root."""
    parts = F.concat(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1), F.split(target, "/"))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside"))

    def step(acc, part):
        up = part == ".."
        path = F.when(part.isin("", "."), acc["path"]).when(up, F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0)))).otherwise(F.concat(acc["path"], F.array(part)))
        return F.struct(path.alias("path"), (acc["inside"] & ~(up & (F.size(acc["path"]) == 0))).alias("inside"))

    end = F.aggregate(parts, start, step)
    return F.when(end["inside"], F.array_join(end["path"], "/"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, file): relative imports (import_id, file, target) that name an existing file, itself included."""
    at = imports.filter(F.col("target").rlike(r"^\.{1,2}/")).select("import_id", resolved_path(F.col("file"), F.col("target")).alias("path"))
    return at.join(files.select("path"), "path").select("import_id", F.col("path").alias("file"))


def unique_matches(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """(site_id, def_id, how): a site's name resolved in its own file if unique there, else globally if unique.

    ``sites``: site_id, file, name. ``definitions``: def_id, file, name.
    """
    near = definitions.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("def_id").alias("near_id")).filter("n = 1").drop("n")
    wide = definitions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("def_id").alias("wide_id")).filter("n = 1").drop("n")
    found = sites.join(near, ["file", "name"], "left").join(wide, "name", "left")
    how = F.when(F.col("near_id").isNotNull(), "file").when(F.col("wide_id").isNotNull(), "global")
    return found.select("site_id", F.coalesce("near_id", "wide_id").alias("def_id"), how.alias("how")).filter("how IS NOT NULL")


def candidates(facts: DataFrame, proposals: DataFrame, cap: int) -> DataFrame:
    """Distinct proposals that aren't facts, in order of source then id, ``cap`` a reason; with ``selected``.

    ``proposals``: ord, reason, rel_type, from_id, to_id. ``facts``: rel_type, from_id, to_id.
    """
    from pyspark.sql import Window

    key = ["rel_type", "from_id", "to_id"]
    new = proposals.join(facts.select(*key), key, "left_anti")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "reason"))).filter("_n = 1").drop("_n")
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("rel_type", "from_id", "to_id"))
    return first.withColumn("rank", rank).withColumn("selected", F.col("rank") <= cap)
