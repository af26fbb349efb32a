"""Compiler indexes in the public SCIP layout: receipts, exact spans, anchors, certified facts and coverage.

An index is one or more parts, protobuf messages whose fields are documents with occurrences and symbols. A
receipt pins what an index was made from: the digest of each part and of each source file. A receipt
with any fault (a digest that differs, a file missing or not pinned, a position outside its line or
within a character, an invalid symbol or path, a part that can't be decoded) certifies nothing: its faults are rows, and
no row of it is among the results.

Positions are lines and columns counted in UTF-8, UTF-16 or UTF-32 units. Sources become pieces of at
most ``PIECE`` characters with running offsets in bytes and in each unit; a coordinate finds its piece by a
range join over bins of units, so neither a long line nor a file with most occurrences is copied for each of
them. Within a piece, built-in functions tell bytes and characters.

An occurrence's anchor is its symbol within the repository, of a local symbol within its file and receipt. A reference
to an anchor of one definition is resolved, of none unresolved, of several ambiguous. Equal occurrences
are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import id_col, sha_col
from ..session import settle

#: Characters of a piece, and units of a bin of the range join.
PIECE = 1024
ENCODINGS = {1: "utf8", 2: "utf16", 3: "utf32"}
#: Marks a second UTF-16 unit while columns are counted; a noncharacter that texts don't hold.
SECOND = "￿"
_ID = r"(?:[\w+\-$]+|`(?:[^`]|``)+`)"
_PART = r"(?:[^ ]|  )*"
#: The public grammar of symbols: local ones, or scheme, manager, name, version and descriptors.
SYMBOL = rf"^(?:local [\w+\-$]+|(?!local )(?:[^ ]|  )+ {_PART} {_PART} {_PART} (?:{_ID}[/#.:!]|{_ID}\([\w+\-$]*\)\.|\[{_ID}\]|\({_ID}\))+)$"

DOCUMENT = (
    "receipt_id string, part string, path string, encoding int, text string, occurrences array<struct<symbol:string,roles:int,range:array<int>,diagnostics:int>>, "
    "symbols array<struct<symbol:string,relations:array<struct<symbol:string,implementation:boolean>>>>, fault string"
)


# --- the wire format -----------------------------------------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: whole numbers, or bytes of length-delimited fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 2, 5):
            n, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            if at + n > len(data):
                raise ValueError("a field ends beyond its message")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    """Whole numbers of a packed field, as 32-bit signed ones."""
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            value &= 0xFFFFFFFF
            out.append(value - (1 << 32) if value >> 31 else value)
            value = shift = 0
    return out


def message(*parts: tuple[int, object]) -> bytes:
    """The inverse of ``fields``: numbers, texts, bytes, or lists of numbers (packed)."""

    def varint(x: int) -> bytes:
        out = bytearray()
        x &= (1 << 64) - 1
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            body = value.encode() if isinstance(value, str) else b"".join(map(varint, value)) if isinstance(value, list) else value
            out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


def _symbol(body: bytes) -> dict:
    """Symbol information: symbol 1, relationships 4; of a relationship symbol 1, implementation 3."""
    parts = list(fields(body))
    relations = [dict(fields(v)) for n, v in parts if n == 4]
    return {
        "symbol": next((v.decode() for n, v in parts if n == 1), ""),
        "relations": [{"symbol": r.get(1, b"").decode(), "implementation": bool(r.get(3, 0))} for r in relations],
    }


def documents_of(content: bytes) -> Iterator[dict]:
    """Documents (field 2 of an index) with path 1, occurrences 2, symbols 3, text 5 and encoding 6; external symbols (3) are a document without a path."""
    outside = []
    for number, body in fields(content):
        if number == 3:
            outside.append(_symbol(body))
        if number != 2:
            continue
        parts = list(fields(body))
        one = lambda n, default, own=parts: next((v for k, v in own if k == n), default)
        found = []
        for n, occurrence in parts:
            if n == 2:
                own = list(fields(occurrence))
                f = dict(own)
                spot = [x for k, v in own if k == 1 for x in ([v] if isinstance(v, int) else packed(v))]
                found.append({"symbol": f.get(2, b"").decode(), "roles": f.get(3, 0), "range": spot, "diagnostics": sum(k == 6 for k, _ in own)})
        yield {
            "path": one(1, b"").decode(),
            "encoding": one(6, 0),
            "text": one(5, b"").decode(),
            "occurrences": found,
            "symbols": [_symbol(v) for n, v in parts if n == 3],
        }
    if outside:
        yield {"path": None, "encoding": 0, "text": "", "occurrences": [], "symbols": outside}


def encoded(document: dict) -> bytes:
    """A part with one document, as ``documents_of`` gives it."""
    occurrences = [(2, message((1, o["range"]), (2, o["symbol"]), (3, o["roles"]), *[(6, b"")] * o.get("diagnostics", 0))) for o in document["occurrences"]]
    symbols = [
        (3, message((1, s["symbol"]), *[(4, message((1, r["symbol"]), (3, int(r["implementation"])))) for r in s["relations"]])) for s in document["symbols"]
    ]
    return message((2, message((1, document["path"]), *occurrences, *symbols, (5, document.get("text", "")), (6, document["encoding"]))))


def decoded(parts: DataFrame) -> DataFrame:
    """The documents of index parts (receipt_id, part, content)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.name for f in schema]
        for batch in batches:
            for receipt, part, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                try:
                    rows = [{"receipt_id": receipt, "part": part, "fault": None} | d for d in documents_of(content or b"")]
                except (ValueError, IndexError, TypeError, AttributeError):
                    rows = [dict.fromkeys(names) | {"receipt_id": receipt, "part": part, "fault": "part can't be decoded"}]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = parts.sparkSession.createDataFrame([], DOCUMENT).schema
    schema = to_arrow_schema(shape)
    return parts.select("receipt_id", "part", "content").mapInArrow(run, shape)


# --- positions -----------------------------------------------------------------------------------------------------


def utf16_units(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xx"))


def pieces(sources: DataFrame) -> DataFrame:
    """(path, line, k, piece, ending, last, byte0, char0, u8, u16): sources (path, text) cut at line ends and every ``PIECE`` characters.

    ``byte0`` is the piece's first byte in the file; ``char0``, ``u8`` and ``u16`` are its first
    character, byte and UTF-16 unit in the line. A carriage return before the line end belongs to the ending.
    """
    lines = sources.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    bare = F.regexp_replace("raw", r"\r\z", "")
    back = F.when(F.col("raw").endswith("\r"), F.lit("\r")).otherwise("")
    lines = lines.select("path", "line", bare.alias("bare"), F.concat(back, F.when(F.col("line") < F.col("n") - 1, F.lit("\n")).otherwise("")).alias("ending"))
    cut = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("bare") / PIECE).cast("int") - 1, F.lit(0)))))
    last = (F.col("k") + 1) * PIECE >= F.length("bare")
    cut = cut.select(
        "path", "line", "k", F.substring("bare", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"), last.alias("last"), F.when(last, F.col("ending")).otherwise("").alias("ending")
    )
    order = Window.partitionBy("path").orderBy("line", "k")
    inline = Window.partitionBy("path", "line").orderBy("k")
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.select(
        "*",
        before(F.octet_length("piece") + F.octet_length("ending"), order).alias("byte0"),
        (F.col("k") * PIECE).alias("char0"),
        before(F.octet_length("piece"), inline).alias("u8"),
        before(utf16_units(F.col("piece")), inline).alias("u16"),
    )


def _unit(encoding: Column, u8: Column, u16: Column, u32: Column) -> Column:
    return F.when(encoding == 1, u8).when(encoding == 2, u16).otherwise(u32)


def located(spots: DataFrame, cut: DataFrame) -> DataFrame:
    """``spots`` (path, encoding, line, column, ...) with byte, chars (before it in its line), k and rest; null where there is no such position.

    ``rest`` is what follows the position in its piece, ``reach`` characters at most.
    """
    used = spots.select("path", "encoding").distinct()
    first = _unit(F.col("encoding"), F.col("u8"), F.col("u16"), F.col("char0"))
    size = _unit(F.col("encoding"), F.octet_length("piece"), utf16_units(F.col("piece")), F.length("piece"))
    spread = cut.join(used, "path").withColumns({"first": first, "size": size})
    end = F.col("first") + F.col("size") - F.when(F.col("last"), 0).otherwise(1)
    spread = spread.withColumn("bin", F.explode(F.sequence((F.col("first") / PIECE).cast("int"), F.greatest(end / PIECE, F.col("first") / PIECE).cast("int"))))
    asked = spots.withColumn("bin", F.floor(F.col("column") / PIECE).cast("int"))
    at = F.col("column") - F.col("first")
    inside = (at >= 0) & F.when(F.col("last"), at <= F.col("size")).otherwise(at < F.col("size"))
    found = asked.join(spread, ["path", "encoding", "line", "bin"]).filter(inside).withColumn("at", at.cast("int"))

    doubled = F.regexp_replace("piece", r"([\x{10000}-\x{10FFFF}])", f"$1{SECOND}")
    byte = F.col("piece").cast("binary")
    prefix = _unit(
        F.col("encoding"),
        F.substring(byte, F.lit(1), F.col("at")).cast("string"),
        F.replace(F.substring(doubled, F.lit(1), F.col("at")), F.lit(SECOND), F.lit("")),
        F.substring("piece", F.lit(1), F.col("at")),
    )
    within = _unit(
        F.col("encoding"),
        F.hex(F.substring(byte, F.col("at") + 1, F.lit(1))).between("80", "BF"),
        F.substring(doubled, F.col("at") + 1, F.lit(1)) == SECOND,
        F.lit(False),
    )
    found = found.filter(~within).withColumn("prefix", prefix)
    return found.select(
        *spots.columns,
        (F.col("byte0") + F.octet_length("prefix")).cast("long").alias("byte"),
        (F.col("char0") + F.length("prefix")).cast("int").alias("chars"),
        "k",
        F.substring("piece", F.length("prefix") + 1, F.col("reach")).alias("rest"),
    )


def spans(occurrences: DataFrame, cut: DataFrame) -> DataFrame:
    """Occurrences (receipt_id, path, n, encoding, symbol, roles, range) with their spans and names; bytes are null where the range is no range of the text."""
    r = F.col("range")
    three, four = F.size(r) == 3, F.size(r) == 4
    ends = {
        "sl": F.when(three | four, r[0]),
        "sc": F.when(three | four, r[1]),
        "el": F.when(three, r[0]).when(four, F.get(r, 2)),
        "ec": F.when(three, r[2]).when(four, F.get(r, F.lit(3))),
    }
    key = ["receipt_id", "path", "n"]
    rows = occurrences.withColumns(ends)
    reach = F.when(F.col("sl") == F.col("el"), F.greatest(F.col("ec") - F.col("sc"), F.lit(0))).otherwise(0)
    spot = lambda which, line, column, far: F.struct(F.lit(which).alias("which"), F.col(line).alias("line"), F.col(column).alias("column"), far.alias("reach"))
    both = rows.select(*key, "encoding", F.explode(F.array(spot(0, "sl", "sc", reach), spot(1, "el", "ec", F.lit(0)))).alias("s")).select(*key, "encoding", "s.*")
    at = located(both, cut)
    side = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    pair = at.groupBy(*key).agg(
        *(side(w, c).alias(f"{c}{w}") for w in (0, 1) for c in ("byte", "chars", "k")), side(0, "rest").alias("rest")
    )
    sound = rows.join(pair, key, "left").withColumn("near", (F.col("sl") == F.col("el")) & (F.col("k0") == F.col("k1")))
    sound = settle(sound, "index-spans")
    short = sound.filter("near OR byte0 IS NULL OR byte1 IS NULL").withColumn("name", F.expr("IF(byte1 >= byte0, substring(rest, 1, chars1 - chars0), NULL)"))

    # A span over several pieces is put together from all of them.
    far = sound.filter("NOT near AND byte0 IS NOT NULL AND byte1 IS NOT NULL")
    lines = far.filter("byte1 >= byte0").select(*key, "byte0", "byte1", F.explode(F.sequence("sl", "el")).alias("line"))
    raw = F.concat("piece", "ending").cast("binary")
    parts = lines.join(cut.select("path", "line", F.col("byte0").alias("b"), raw.alias("raw")), ["path", "line"])
    low = F.greatest(F.col("byte0") - F.col("b"), F.lit(0))
    high = F.least(F.col("byte1") - F.col("b"), F.octet_length("raw"))
    clipped = parts.filter(high > low).select(*key, "b", F.substring("raw", (low + 1).cast("int"), (high - low).cast("int")).cast("string").alias("text"))
    told = clipped.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "text"))), lambda x: x["text"]), "").alias("name"))
    long = far.join(told, key, "left").withColumn("name", F.when(F.col("byte1") >= F.col("byte0"), F.coalesce("name", F.lit(""))))
    return short.unionByName(long).select(
        *occurrences.columns,
        "name",
        (F.col("sl") + 1).alias("start_line"),
        (F.col("chars0") + 1).alias("start_col"),
        (F.col("el") + 1).alias("end_line"),
        (F.col("chars1") + 1).alias("end_col"),
        F.when(F.col("byte1") >= F.col("byte0"), F.col("byte0")).alias("byte_start"),
        F.when(F.col("byte1") >= F.col("byte0"), F.col("byte1")).alias("byte_end"),
    )


# --- receipts ------------------------------------------------------------------------------------------------------


def pin_faults(parts: DataFrame, sources: DataFrame, part_pins: DataFrame, source_pins: DataFrame) -> DataFrame:
    """(receipt_id, path, fault): where parts (receipt_id, part, content) and sources (path, text) aren't what a receipt pins.

    ``part_pins``: receipt_id, part, sha256; ``source_pins``: receipt_id, path, sha256, bytes.
    """
    own = parts.select("receipt_id", "part", F.sha2("content", 256).alias("now"))
    index = part_pins.join(own, ["receipt_id", "part"], "full").filter("NOT (sha256 <=> now)")
    told = F.when(F.col("now").isNull(), "part missing").when(F.col("sha256").isNull(), "part not pinned").otherwise("part changed")
    index = index.select("receipt_id", F.col("part").alias("path"), told.alias("fault"))
    files = sources.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    scoped = files.crossJoin(F.broadcast(part_pins.select("receipt_id").distinct()))
    kept = source_pins.join(scoped, ["receipt_id", "path"], "full").filter("NOT (sha256 <=> now AND bytes <=> size)")
    told = F.when(F.col("now").isNull(), "source missing").when(F.col("sha256").isNull(), "source not pinned").otherwise("source changed")
    return index.unionByName(kept.select("receipt_id", "path", told.alias("fault")))


@dataclass
class Normalised:
    """``occurrences``, ``facts``, ``files`` (coverage of each file), ``totals`` of each receipt, ``faults``."""

    occurrences: DataFrame
    facts: DataFrame
    files: DataFrame
    totals: DataFrame
    faults: DataFrame


def normalised(parts: DataFrame, sources: DataFrame, receipts: DataFrame, part_pins: DataFrame, source_pins: DataFrame) -> Normalised:
    """Occurrences and facts of index parts whose receipts hold.

    ``receipts``: receipt_id, repo, producer, unspecified (the encoding, 1 to 3, of documents that
    name none; null: such documents are a fault).
    """
    documents = settle(decoded(parts), "index-documents").join(F.broadcast(receipts), "receipt_id")
    named = documents.filter("path IS NOT NULL")
    encoding = F.when(F.col("encoding") == 0, F.col("unspecified")).when(F.col("encoding").between(1, 3), F.col("encoding"))
    seen = named.join(sources.select("path", F.coalesce("text", F.lit("")).alias("source")), "path", "left").withColumn("unit", encoding)
    bad_path = F.col("path").rlike(r"^$|^/|^[A-Za-z]:|\\|(^|/)\.\.?(/|$)|//")
    in_scope = F.col("source").isNotNull()
    of_document = (
        F.when(bad_path, "path isn't relative")
        .when(in_scope & (F.col("text") != "") & (F.col("text") != F.col("source")), "embedded text differs")
        .when(in_scope & F.col("unit").isNull(), "unknown position encoding")
    )
    checked = seen.select("receipt_id", "path", of_document.alias("fault"), in_scope.alias("in_scope"), "unit", F.size("occurrences").alias("n_occurrences"))
    checked = settle(checked, "index-checked")
    several = named.groupBy("receipt_id", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("receipt_id", "path", F.lit("path occurs twice").alias("fault"))

    cut = settle(pieces(sources), "index-pieces")
    scoped = named.drop("fault").join(checked.filter("in_scope AND unit IS NOT NULL").select("receipt_id", "path", "unit").distinct(), ["receipt_id", "path"])
    each = scoped.select("receipt_id", "repo", "producer", "path", F.col("unit").alias("encoding"), F.posexplode("occurrences").alias("n", "o"))
    each = each.select("receipt_id", "repo", "producer", "path", "encoding", "n", F.col("o.symbol").alias("symbol"), F.col("o.roles").alias("roles"), F.col("o.range").alias("range"))
    spanned = settle(spans(each, cut), "index-occurrences")
    of_span = F.when(F.col("byte_start").isNull(), "position outside its document").when((F.col("symbol") != "") & ~F.col("symbol").rlike(SYMBOL), "invalid symbol")
    relations = settle(
        named.select("receipt_id", "repo", "path", F.explode("symbols").alias("s")).select("receipt_id", "repo", "path", F.col("s.symbol").alias("a"), F.explode("s.relations").alias("r"))
        .select("receipt_id", "repo", "path", "a", F.col("r.symbol").alias("b"), F.col("r.implementation").alias("implementation")),
        "index-relations",
    )
    of_relation = F.col("implementation") & ~(F.col("a").rlike(SYMBOL) & F.col("b").rlike(SYMBOL))
    faults = [
        pin_faults(parts, sources, part_pins, source_pins),
        documents.filter("fault IS NOT NULL").select("receipt_id", F.col("part").alias("path"), "fault"),
        checked.filter("fault IS NOT NULL").select("receipt_id", "path", "fault"),
        several,
        spanned.withColumn("fault", of_span).filter("fault IS NOT NULL").select("receipt_id", "path", "fault"),
        relations.filter(of_relation).select("receipt_id", "path", F.lit("invalid symbol").alias("fault")),
    ]
    faults = settle(reduce(DataFrame.unionByName, faults).distinct(), "index-faults")
    sound = receipts.join(faults.select("receipt_id").distinct(), "receipt_id", "left_anti")
    holds = F.broadcast(sound.select("receipt_id"))

    local = lambda c: F.col(c).startswith("local ")
    anchor = lambda c: F.concat(F.lit("symbol:"), F.when(local(c), sha_col(F.col("repo"), F.col("receipt_id"), F.col("path"), F.col(c))).otherwise(sha_col(F.col("repo"), F.col(c))))
    definition = F.col("roles").bitwiseAND(1) == 1
    kept = spanned.join(holds, "receipt_id", "left_semi").filter("symbol <> ''")
    kind = F.when(definition, "definition").otherwise("symbol")
    occurrence_id = id_col("ent", kind, F.col("receipt_id"), F.col("path"), F.col("symbol"), F.col("byte_start"), F.col("byte_end"), F.col("roles"))
    found = kept.select(
        occurrence_id.alias("occurrence_id"), "receipt_id", "repo", "producer", "path", kind.alias("kind"), "symbol", anchor("symbol").alias("anchor"), local("symbol").alias("local"), "roles", "name",
        "start_line", "start_col", "end_line", "end_col", "byte_start", "byte_end",
    ).dropDuplicates(["occurrence_id"])
    found = settle(found, "index-found")

    defined = found.filter("kind = 'definition'")
    homes = defined.groupBy("receipt_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("occurrence_id", "path")).alias("home"))
    homes = settle(homes, "index-homes")
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    one = F.col("n") == 1
    told = found.join(homes, ["receipt_id", "anchor"], "left").select(
        *found.columns, F.when(F.col("kind") == "symbol", state).alias("state"), F.when((F.col("kind") == "symbol") & one, F.col("home")).alias("target")
    )
    told = settle(told, "index-told")
    spot = ["path", "byte_start", "byte_end", F.col("name").alias("text"), "producer"]
    defines = defined.select("receipt_id", id_col("ent", "file", F.col("path")).alias("from_id"), F.col("occurrence_id").alias("to_id"), F.lit("defines").alias("rel_type"), *spot)
    references = told.filter("state = 'resolved'").select("receipt_id", F.col("occurrence_id").alias("from_id"), F.col("target.occurrence_id").alias("to_id"), F.lit("references").alias("rel_type"), *spot)

    wanted = relations.filter("implementation").join(holds, "receipt_id", "left_semi")
    wanted = wanted.select("receipt_id", anchor("a").alias("a"), anchor("b").alias("b"), "path").groupBy("receipt_id", "a", "b").agg(F.min("path").alias("path"))
    unique = homes.filter("n = 1").select("receipt_id", "anchor", F.col("home.occurrence_id").alias("id"))
    ends = wanted.join(unique.withColumnsRenamed({"anchor": "a", "id": "from_id"}), ["receipt_id", "a"], "left").join(unique.withColumnsRenamed({"anchor": "b", "id": "to_id"}), ["receipt_id", "b"], "left")
    ends = ends.join(sources.select("path", F.lit(True).alias("captured")), "path", "left")
    ends = settle(ends.withColumn("resolved", F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("captured").isNotNull()), "index-implementations")
    implements = ends.filter("resolved").select("receipt_id", "from_id", "to_id").join(defined.select("receipt_id", F.col("occurrence_id").alias("from_id"), *spot), ["receipt_id", "from_id"])
    facts = defines.unionByName(references).unionByName(implements.withColumn("rel_type", F.lit("implements")).select(*defines.columns))

    names = F.element_at(F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair]), F.col("unit"))
    indexed = checked.join(holds, "receipt_id", "left_semi").select(
        "receipt_id", "path", F.when(F.col("in_scope"), "indexed").otherwise("outside_source_scope").alias("status"), F.when(F.col("in_scope"), names).alias("encoding"), "n_occurrences"
    )
    omitted = sources.select("path").crossJoin(F.broadcast(sound.select("receipt_id"))).join(checked.select("receipt_id", "path"), ["receipt_id", "path"], "left_anti")
    omitted = omitted.select("receipt_id", "path", F.lit("omitted_by_indexer").alias("status"), F.lit(None).cast("string").alias("encoding"), F.lit(0).alias("n_occurrences"))
    count = lambda x: F.count(F.when(x, 1)).alias
    totals = told.groupBy("receipt_id").agg(
        count(F.col("kind") == "definition")("definitions"), count(F.col("state") == "resolved")("references"),
        count(F.col("state") == "unresolved")("unresolved_references"), count(F.col("state") == "ambiguous")("ambiguous_references"),
    )
    bare = spanned.filter("symbol = ''").groupBy("receipt_id").agg(F.count(F.lit(1)).alias("symbol_less"))
    made = ends.groupBy("receipt_id").agg(count(F.col("resolved"))("implementations"), count(~F.col("resolved"))("unresolved_implementations"))
    outside = documents.filter("path IS NULL AND fault IS NULL").select("receipt_id", F.aggregate(F.transform("symbols", lambda s: F.size(s["relations"])), F.lit(0), lambda a, b: a + b).alias("n"))
    other = relations.filter("NOT implementation").select("receipt_id", F.lit(1).alias("n")).unionByName(outside).groupBy("receipt_id").agg(F.sum("n").alias("unsupported_relationships"))
    notes = named.select("receipt_id", F.aggregate(F.transform("occurrences", lambda o: o["diagnostics"]), F.lit(0), lambda a, b: a + b).alias("n")).groupBy("receipt_id").agg(F.sum("n").alias("diagnostics"))
    rows = sound.select("receipt_id", "producer")
    for part in (totals, bare, made, other, notes):
        rows = rows.join(part, "receipt_id", "left")
    totals = rows.fillna(0).withColumns({"calls": F.lit("unsupported"), "typecheck": F.lit("unknown")})
    return Normalised(told, facts, indexed.unionByName(omitted), totals, faults)
