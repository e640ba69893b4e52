"""The map's tables in a relational database, read and written through Spark's JDBC source.

The database's driver is the session's to bring (``spark.jars`` or ``spark.jars.packages``). Reads are cut
into ranges of the document's id, which an index on it serves, one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans import evolve
from docweave.plans.model import RelMap, Table

#: Characters of ids in the order of their bytes.
ID_CHARACTERS = "-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Ranges that a table is read in, and rows of a round trip.
RANGES, FETCH = 16, 10_000
#: Letters of an id that a table made here has room for.
LONGEST_ID = 1024


def ranges(column: str, n: int) -> list[str]:
    """n conditions by the column's first character; each value, and null, meets exactly one."""
    cuts = [ID_CHARACTERS[len(ID_CHARACTERS) * i // n] for i in range(1, min(n, len(ID_CHARACTERS)))]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < '{cuts[0]}' OR {column} IS NULL", *inner, f"{column} >= '{cuts[-1]}'"]


def read_table(spark: SparkSession, url: str, table: Table, schema: str = "", n: int = RANGES, **properties: str) -> DataFrame:
    """One table in the map's own types. Filters and columns reach the database."""
    key = "id" if table.kind == "base" else "rid"
    name = f"{schema}.{table.name}" if schema else table.name
    found = spark.read.jdbc(url, name, predicates=ranges(f'"{key}"', n), properties={"fetchsize": str(FETCH)} | properties)
    have = {f.name.lower(): f for f in found.schema}
    # a column of the right type stays as it is, so that filters on it reach the database
    same = lambda f, kind: F.col(f.name) if f.dataType.simpleString() == kind else F.col(f.name).cast(kind)
    return found.select(*(same(have[c.lower()], kind).alias(c) for c, kind in evolve.columns(table)))


def read_tables(spark: SparkSession, url: str, relmap: RelMap, kind: str, schema: str = "", n: int = RANGES, **properties: str) -> dict[str, DataFrame]:
    """All tables of a type, as reconstruct() and searches take them."""
    return {t.name: read_table(spark, url, t, schema, n, **properties) for t in relmap.resources[kind].tables if t.kind != "history"}


def write_table(df: DataFrame, url: str, table: Table, schema: str = "", mode: str = "append", **properties: str) -> None:
    """Rows into a database's table, created if it isn't there; a task's rows go in batches."""
    name = f"{schema}.{table.name}" if schema else table.name
    key = f"`{'id' if table.kind == 'base' else 'rid'}` VARCHAR({LONGEST_ID})"  # so that it can be compared and indexed
    df.select(*(c for c, _ in evolve.columns(table))).write.jdbc(url, name, mode, {"batchsize": str(FETCH), "createTableColumnTypes": key} | properties)
