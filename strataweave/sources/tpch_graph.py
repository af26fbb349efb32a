"""The versioned graph that the star-schema tables stand for.

Nodes: regions, nations (modules), customers, suppliers (symbols), parts, orders (definitions).
Edges: region contains nation, nation contains customer and supplier, customer calls order,
order references part, supplier implements part. An edge's evidence class follows from its
line items' return flags. Build 1 has the orders before ``CUT``, build 2 all of them.

Both builds are derived once a session and stored, nodes by the table they come from, edges by build
and relation type, so that readers open only the folders and columns they need, as readers of any
published build do. ``derived_nodes`` and ``derived_edges`` are the derivation itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import deterministic_id, id_col
from ..session import shared_dir, shared_path, table

REPO, SNAPSHOT, BUILD = "star", "snap-1", "build-2"
CUT = "1995-06-01"


def entity_id(kind: str, qualified_name: str) -> str:
    return deterministic_id("ent", REPO, SNAPSHOT, kind, qualified_name, "1", "1")


def entity_col(kind: str, qualified_name: Column) -> Column:
    return id_col("ent", REPO, SNAPSHOT, kind, qualified_name, "1", "1")


def _qn(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.col(key).cast("string"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders")
TYPES = ("contains", "calls", "references", "implements")


def derived_nodes(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = TABLES) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation, region = t("nation"), t("region")
    home = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)

    def rows(df, kind, name, qn, file):
        return df.select(
            entity_col(kind, qn).alias("entity_id"),
            F.lit(kind).alias("kind"),
            name.alias("name"),
            qn.alias("qualified_name"),
            file.alias("file"),
            F.lower(name).alias("name_fold"),
            F.lower(qn).alias("qn_fold"),
        )

    col, cat = F.col, F.concat
    parts = {
        "region": lambda: rows(region, "module", col("r_name"), _qn("region", "r_name"), cat(F.lit("geo/"), "r_name", F.lit(".md"))),
        "nation": lambda: rows(home, "module", col("n_name"), _qn("nation", "n_name"), cat(F.lit("geo/"), "r_name", F.lit("/"), "n_name", F.lit(".md"))),
        "customer": lambda: rows(
            t("customer").join(F.broadcast(nation), col("c_nationkey") == col("n_nationkey")),
            "symbol", col("c_name"), _qn("customer", "c_custkey"), cat(F.lit("crm/"), "c_mktsegment", F.lit("/"), "n_name", F.lit(".rs")),
        ),
        "supplier": lambda: rows(
            t("supplier").join(F.broadcast(nation), col("s_nationkey") == col("n_nationkey")),
            "symbol", col("s_name"), _qn("supplier", "s_suppkey"), cat(F.lit("supply/"), "n_name", F.lit("/suppliers.rs")),
        ),
        "part": lambda: rows(t("part"), "definition", col("p_name"), _qn("part", "p_partkey"), cat(F.lit("catalog/"), "p_brand", F.lit("/"), "p_type", F.lit(".rs"))),
        "orders": lambda: rows(
            t("orders"), "definition", cat(F.lit("order-"), col("o_orderkey").cast("string")), _qn("order", "o_orderkey"), cat(F.lit("crm/"), "o_orderpriority", F.lit("/orders.rs")),
        ),
    }
    return reduce(DataFrame.unionAll, [parts[k]().withColumn("origin", F.lit(k)) for k in only])


def derived_edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = TYPES, build: int = 2) -> DataFrame:
    """rel_id, rel_type, from_id, to_id, class."""
    t = lambda name: table(spark, sf_dir, name)
    col = F.col
    out = []

    def rows(df, kind, a, b, evidence=None):
        e = df.select(a.alias("from_id"), b.alias("to_id"), (evidence if evidence is not None else F.lit("extracted")).alias("class"))
        return e.select(id_col("rel", BUILD, kind, col("from_id"), col("to_id")).alias("rel_id"), F.lit(kind).alias("rel_type"), "from_id", "to_id", "class")

    region, nation = t("region"), t("nation")
    nation_id = entity_col("module", _qn("nation", "n_name"))
    if "contains" in types:
        home = nation.join(F.broadcast(region), col("n_regionkey") == col("r_regionkey"))
        out.append(rows(home, "contains", entity_col("module", _qn("region", "r_name")), nation_id))
        for name, key, at in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
            held = t(name).join(F.broadcast(nation), col(at) == col("n_nationkey"))
            out.append(rows(held, "contains", nation_id, entity_col("symbol", _qn(name, key))))
    orders = t("orders")
    if build == 1:
        orders = orders.filter(col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    if "calls" in types:
        out.append(rows(orders, "calls", entity_col("symbol", _qn("customer", "o_custkey")), entity_col("definition", _qn("order", "o_orderkey"))))
    lines = t("lineitem")
    if build == 1:
        lines = lines.join(orders.select("o_orderkey"), col("l_orderkey") == col("o_orderkey"), "left_semi")
    worst = F.max(F.when(col("l_returnflag") == "R", 2).when(col("l_returnflag") == "A", 1).otherwise(0))
    label = F.when(col("w") == 2, "ambiguous").when(col("w") == 1, "inferred").otherwise("extracted")
    for kind, key, prefix, a in (("references", "l_orderkey", "order", "definition"), ("implements", "l_suppkey", "supplier", "symbol")):
        if kind in types:
            pairs = lines.groupBy(key, "l_partkey").agg(worst.alias("w"))
            out.append(rows(pairs, kind, entity_col(a, _qn(prefix, key)), entity_col("definition", _qn("part", "l_partkey")), label))
    return reduce(DataFrame.unionAll, out)


#: Paths of stored builds by session and folder.
_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of both builds, written when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _stored.get(key)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path or shared_dir(spark)}/edges/_SUCCESS")
    if path is None or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        path = shared_path(spark, "star-builds")
        derived_nodes(spark, sf_dir).write.partitionBy("origin").parquet(f"{path}/nodes")
        both = [derived_edges(spark, sf_dir, build=b).withColumn("build", F.lit(b)) for b in (1, 2)]
        both[0].unionAll(both[1]).write.partitionBy("build", "rel_type").parquet(f"{path}/edges")
        _stored[key] = path
    return path


def nodes(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = TABLES) -> DataFrame:
    """entity_id, kind, name, qualified_name, file, name_fold, qn_fold."""
    columns = "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string"
    rows = spark.read.schema(f"{columns}, origin string").parquet(f"{stored(spark, sf_dir)}/nodes")
    return (rows if tuple(only) == TABLES else rows.filter(F.col("origin").isin(*only))).drop("origin")


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = TYPES, build: int = 2) -> DataFrame:
    """rel_id, rel_type, from_id, to_id, class."""
    rows = spark.read.schema("rel_id string, from_id string, to_id string, class string, build int, rel_type string").parquet(f"{stored(spark, sf_dir)}/edges")
    rows = rows.filter(F.col("build") == build)
    return (rows if tuple(types) == TYPES else rows.filter(F.col("rel_type").isin(*types))).select("rel_id", "rel_type", "from_id", "to_id", "class")
