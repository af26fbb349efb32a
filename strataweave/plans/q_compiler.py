"""Queries of compiler indexes. The index is made from ``documents``: a source file each, a line's second word is an occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compiler_index as C
from ..session import settle, table
from .registry import query

#: Sources start with a character of two UTF-16 units, so that the three encodings count differently.
LEAD = "𝔘é "
WORDS = r"^([^ \t\r]+[ \t]+)([^ \t\r]+)"


def sources(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit(LEAD), F.coalesce("text", F.lit(""))).alias("text"))


def documents(files):
    """The index documents of sources: units by turns of the id, definitions on the first line of every third file."""
    lines = files.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before, word = F.regexp_extract("line", WORDS, 1), F.regexp_extract("line", WORDS, 2)
    own = lines.select("doc_id", "path", "i", before.alias("before"), word.alias("word")).filter("word <> ''")
    unit = F.pmod("doc_id", F.lit(3)) + 1
    units = lambda x: F.when(unit == 1, F.octet_length(x)).when(unit == 2, (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")).otherwise(F.length(x))
    symbol = F.concat(F.lit("scip-text pip corpus 1 `"), F.replace("word", F.lit("`"), F.lit("``")), F.lit("`#"))
    role = F.when((F.col("i") == 0) & (F.pmod(F.expr("doc_id div 3"), F.lit(3)) == 0), 1).otherwise(0)
    spot = F.array(F.col("i"), units(F.col("before")), units(F.concat("before", "word")))
    own = own.select("doc_id", "path", unit.cast("int").alias("encoding"), "i", F.struct("i", symbol.alias("symbol"), role.alias("roles"), spot.alias("range"), F.lit(0).alias("diagnostics")).alias("o"))
    return own.groupBy("doc_id", "path", "encoding").agg(F.sort_array(F.collect_list("o")).alias("occurrences"))


def index(spark, d):
    """(parts, sources, receipts, part pins, source pins): a part for each document, all under one receipt."""
    files = sources(spark, d)
    related = F.expr("filter(occurrences, o -> o.i IN (0, 1))")
    pair = F.when(F.size(related) == 2, F.array(F.struct(related[0]["symbol"].alias("symbol"), F.array(F.struct(related[1]["symbol"].alias("symbol"), (F.col("doc_id") % 2 == 0).alias("implementation"))).alias("relations"))))
    rows = documents(files).select("path", "encoding", "occurrences", pair.alias("symbols"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(r["path"], C.encoded(r | {"symbols": r["symbols"] or []})) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], names=["part", "content"])

    parts = rows.mapInArrow(run, "part string, content binary").select(F.lit("scip-1").alias("receipt_id"), "part", "content")
    parts = settle(parts, "index-parts")
    receipts = spark.createDataFrame([("scip-1", "star", "indexer-1", None)], "receipt_id string, repo string, producer string, unspecified int")
    part_pins = parts.select("receipt_id", "part", F.sha2("content", 256).alias("sha256"))
    files = files.select("path", "text")
    pins = files.select(F.lit("scip-1").alias("receipt_id"), "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return parts, files, receipts, part_pins, pins


def _esc(text: str) -> str:
    return text.replace("'", "''")


#: Each occurrence in DuckDB: byte offsets from the texts themselves, not from counted units.
OCC = f"""f AS (SELECT doc_id, 'docs/'||doc_id||'.txt' AS path, '{LEAD}'||coalesce(text,'') AS text FROM documents),
l AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM f),
b AS (SELECT *, coalesce(sum(strlen(line)+1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, regexp_extract(line, '{WORDS}', 1) AS before, regexp_extract(line, '{WORDS}', 2) AS word FROM l),
o AS (SELECT doc_id, path, i, word, (i+1)::INT AS start_line, (length(before)+1)::INT AS start_col, pos+strlen(before) AS byte_start, pos+strlen(before)+strlen(word) AS byte_end, i=0 AND (doc_id//3)%3=0 AS def FROM b WHERE word<>''),
h AS (SELECT word, count(*) AS n, min(path) AS home FROM o WHERE def GROUP BY 1)"""


@query(
    "e12_reference_spans",
    f"WITH {OCC} SELECT o.path, o.word AS name, start_line, start_col, byte_start, byte_end, CASE WHEN n IS NULL THEN 'unresolved' WHEN n=1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n=1 THEN home END AS target_path FROM o LEFT JOIN h USING (word) WHERE NOT def",
)
def e12(spark, d):
    """Every reference with its exact span and what defines it; the three encodings by turns."""
    told = C.normalised(*index(spark, d)).occurrences.filter("kind = 'symbol'")
    return told.select("path", "name", "start_line", "start_col", "byte_start", "byte_end", "state", F.col("target.path").alias("target_path"))


@query(
    "e12_facts",
    f"""WITH {OCC}, x AS (SELECT a.word AS a, z.word AS z, min(a.path) AS path FROM o a JOIN o z ON a.path=z.path AND a.i=0 AND z.i=1 WHERE a.doc_id%2=0 GROUP BY 1,2)
    SELECT 'defines' AS rel_type, path, word AS text, byte_start, byte_end FROM o WHERE def UNION ALL SELECT 'references', o.path, o.word, byte_start, byte_end FROM o JOIN h ON h.word=o.word AND n=1 WHERE NOT def
    UNION ALL SELECT 'implements', o.path, o.word, byte_start, byte_end FROM x JOIN h ON h.word=x.a AND h.n=1 JOIN h g ON g.word=x.z AND g.n=1 JOIN o ON o.def AND o.word=x.a""",
)
def e12f(spark, d):
    return C.normalised(*index(spark, d)).facts.select("rel_type", "path", "text", "byte_start", "byte_end")


@query(
    "e12_coverage",
    f"WITH {OCC}, k AS (SELECT path, any_value(doc_id) AS doc_id, count(*)::INT AS n FROM o GROUP BY 1) SELECT f.path, CASE WHEN n IS NULL THEN 'omitted_by_indexer' ELSE 'indexed' END AS status, CASE WHEN n IS NOT NULL THEN ['utf8','utf16','utf32'][f.doc_id%3+1] END AS encoding, coalesce(n,0)::INT AS n_occurrences FROM f LEFT JOIN k USING (path)",
)
def e12c(spark, d):
    return C.normalised(*index(spark, d)).files.select("path", "status", "encoding", "n_occurrences")


@query(
    "s10_pin_faults",
    """WITH f AS (SELECT 'docs/'||doc_id||'.txt' AS path, doc_id FROM documents) SELECT path, CASE WHEN doc_id%13=0 THEN 'source not pinned' ELSE 'source changed' END AS fault FROM f WHERE doc_id%13=0 OR doc_id%11=0
    UNION ALL SELECT 'docs/gone.txt', 'source missing'""",
)
def s10(spark, d):
    """What a receipt says that pinned other sources than there are; it certifies nothing then."""
    parts, files, receipts, part_pins, pins = index(spark, d)
    doc_id = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    pins = pins.filter(doc_id % 13 != 0).withColumn("sha256", F.when(doc_id % 11 == 0, "other").otherwise(F.col("sha256")))
    gone = spark.createDataFrame([("scip-1", "docs/gone.txt", "x", 1)], "receipt_id string, path string, sha256 string, bytes long")
    done = C.normalised(parts, files, receipts, part_pins, pins.unionByName(gone))
    left = done.occurrences.select("path", F.lit("certified in spite of faults").alias("fault"))
    return done.faults.select("path", "fault").unionByName(left)
