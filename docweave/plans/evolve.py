"""Schemas of the map's tables, what differs between two maps, and upgrades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.functions.temporal import date_sort, datetime_sort
from docweave.functions.text import folded
from docweave.plans.model import SPARK, RelMap, Resource, Table

SYSTEM = {
    "base": [("id", "string"), ("version_id", "bigint"), ("last_updated", "timestamp")], "elem": [("rid", "string"), ("ords", "array<smallint>")],
    "ext": [("rid", "string"), ("path", "string"), ("ords", "array<smallint>"), ("modifier", "boolean"), ("ext_ord", "smallint"), ("url", "string"), ("leaf", "string"), ("v_kind", "string"), ("v_text", "string"), ("v_num", "decimal(38,18)"), ("v_bool", "boolean")],
    "deep": [("rid", "string"), ("path", "string"), ("ords", "array<smallint>"), ("leaf", "string"), ("v_kind", "string"), ("v_text", "string"), ("v_num", "decimal(38,18)"), ("v_bool", "boolean")],
    "contained": [("rid", "string"), ("ord", "smallint"), ("resource", "string")],
    "history": [("id", "string"), ("version_id", "bigint"), ("last_updated", "timestamp"), ("op", "string"), ("resource", "string"), ("actor", "string"), ("prev_hash", "binary"), ("row_hash", "binary"), ("prev_hash3", "binary"), ("row_hash3", "binary"), ("row_mac", "string")],
}


def columns(table: Table) -> list[tuple[str, str]]:
    return SYSTEM[table.kind] + [(c.name, SPARK.get(c.kind, c.kind)) for c in table.columns]


def schema(table: Table) -> StructType:
    return StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns(table)))


def ddl(relmap: RelMap, kinds: list[str] | None = None) -> list[str]:
    """CREATE statements; child rows are kept in order of their document, so a document's rows are together."""
    out = [f"CREATE DATABASE IF NOT EXISTS {relmap.schema}"]
    for k in kinds or relmap.resources:
        for t in relmap.resources[k].tables:
            out.append(f"CREATE TABLE IF NOT EXISTS {relmap.schema}.{t.name} ({', '.join(f'`{n}` {x}' for n, x in columns(t))}) USING parquet")
    return out


#: Kinds of search targets that look for exact values, and which of their columns they look in.
EXACT = {"token": ("code",), "reference": ("id", "url"), "uri": ("col",), "quantity": ("code",)}


def layout(resource: Resource, table: Table) -> tuple[list[str], dict[str, str]]:
    """What stands for indexes: (columns that a table's files are sorted by, options for writing it).

    Files sorted by the document's id let reads of few documents, and joins by id, skip row groups by
    their least and greatest ids; columns that searches compare with exact values get Bloom filters.
    """
    order = {"base": ["id"], "contained": ["rid", "ord"], "ext": ["rid", "path", "ords"], "deep": ["rid", "path", "ords"]}.get(table.kind, ["rid", "ords"])
    have = {c.name for c in table.columns}
    found = {t.columns.get(c) for p in resource.params for t in p.targets if resource.tables[t.table].name == table.name for c in EXACT.get(t.kind, ())}
    return order, {f"parquet.bloom.filter.enabled#{c}": "true" for c in sorted(found & have)}


def install(spark: SparkSession, relmap: RelMap, kinds: list[str] | None = None) -> int:
    """Creates the tables that aren't there; the number of statements."""
    statements = ddl(relmap, kinds)
    for s in statements:
        spark.sql(s)
    return len(statements)


def drop(spark: SparkSession, relmap: RelMap) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {relmap.schema} CASCADE")


def catalog(spark: SparkSession, relmap: RelMap) -> DataFrame:
    """(table, column, type) of every column."""
    return spark.createDataFrame([(t.name, n, x) for r in relmap.resources.values() for t in r.tables for n, x in columns(t)], "table_name string, column_name string, type string")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, old type, new type): what was added, removed or has another type."""
    a, b = old.withColumnRenamed("type", "old_type"), new.withColumnRenamed("type", "new_type")
    both = a.join(b, ["table_name", "column_name"], "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_type").eqNullSafe(F.col("new_type"))).select("table_name", "column_name", change.alias("change"), "old_type", "new_type")


@dataclass
class Upgrade:
    added: list[tuple[str, str, str]]
    removed: list[tuple[str, str]]
    backfill: list[tuple[str, str, str]]  # table, source, folded column


def plan(spark: SparkSession, old: RelMap, new: RelMap, destructive: bool = False) -> Upgrade:
    """What an upgrade does; a changed type is refused, and so is a removal unless ``destructive``."""
    rows = diff(catalog(spark, old), catalog(spark, new)).collect()
    changed = [f"{r.table_name}.{r.column_name}" for r in rows if r.change == "changed"]
    if changed:
        raise ValueError(f"columns of another type: {', '.join(sorted(changed))}")
    removed = sorted((r.table_name, r.column_name) for r in rows if r.change == "removed")
    if removed and not destructive:
        raise ValueError(f"the new map lacks {len(removed)} columns; say destructive to drop them")
    added = sorted((r.table_name, r.column_name, r.new_type) for r in rows if r.change == "added")
    names = {(t, c) for t, c, _ in added}
    fold = [(t.name, c.derived, c.name) for r in new.resources.values() for t in r.tables for c in t.columns if c.derived and c.name.endswith("_norm") and (t.name, c.name) in names]
    return Upgrade(added, removed, fold)


def backfill(df: DataFrame, source: str, target: str) -> DataFrame:
    """Fills a folded column where it is null: distinct values are folded once, then joined back."""
    values = df.where(F.col(source).isNotNull() & F.col(target).isNull()).select(source).distinct()
    values = values.select(F.col(source).alias("__value"), folded(F.col(source)).alias("__folded"))
    joined = df.join(values, df[source] == values["__value"], "left")
    return joined.withColumn(target, F.coalesce(F.col(target), F.col("__folded"))).select(*df.columns)


#: How columns derived from a text are computed.
DERIVED = {"num": lambda c: c.try_cast("decimal(38,18)"), "day": date_sort, "instant": datetime_sort}


def upgraded(df: DataFrame, table: Table, old: Table) -> DataFrame:
    """A table's rows under the new map: new columns null, those derived from others filled."""
    for name, kind in columns(table):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    have = {c.name for c in old.columns}
    for c in table.columns:
        if c.derived and c.name not in have and c.derived in df.columns:
            df = backfill(df, c.derived, c.name) if c.name.endswith("_norm") else df.withColumn(c.name, DERIVED[c.kind](F.col(c.derived)))
    return df.select(*(n for n, _ in columns(table)))
