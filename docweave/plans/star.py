"""A map bound to the star-schema tables: customers, orders with items, parts and so on as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import folded
from docweave.plans.model import Param, RelMap, Resource, Table, Target


def _ref(name: str) -> dict[str, str | None]:
    return {"type": f"{name}_ref_type", "id": f"{name}_ref_id", "url": f"{name}_ref_url"}


def _str(col: str) -> dict[str, str | None]:
    return {"col": col, "norm": f"{col}_norm"}


MAP = RelMap("star", {
    "Region": Resource("Region", [Table("region")], params=[Param("name", "string", [Target(0, "string", _str("name"))])]),
    "Nation": Resource("Nation", [Table("nation")], params=[
        Param("name", "string", [Target(0, "string", _str("name"))]), Param("region", "reference", [Target(0, "reference", _ref("region"))])]),
    "Customer": Resource("Customer", [Table("customer")], params=[
        Param("name", "string", [Target(0, "string", _str("name"))]), Param("segment", "token", [Target(0, "token", {"code": "segment", "system": None})]),
        Param("balance", "number", [Target(0, "number", {"col": "balance"})]), Param("nation", "reference", [Target(0, "reference", _ref("nation"))]),
        Param("special", "composite", note="a composite parameter has no path of its own")]),
    "Order": Resource("Order", [Table("orders"), Table("order_item", "elem"), Table("order_period", "elem")], params=[
        Param("status", "token", [Target(0, "token", {"code": "status", "system": None})]),
        Param("priority", "token", [Target(0, "token", {"code": "priority_code", "system": "priority_system"})]),
        Param("date", "date", [Target(0, "date", {"lo": "date", "hi": None})]),
        Param("total", "number", [Target(0, "number", {"col": "total"})]),
        Param("customer", "reference", [Target(0, "reference", _ref("customer"))]),
        Param("item-quantity", "quantity", [Target(1, "quantity", {"col": "quantity", "system": None, "code": None})]),
        Param("item-date", "date", [Target(1, "date", {"lo": "ship_date", "hi": None})]),
        Param("item-flag", "token", [Target(1, "token", {"code": "return_flag", "system": "line_status"})]),
        Param("part", "reference", [Target(1, "reference", _ref("part"))]),
        Param("supplier", "reference", [Target(1, "reference", _ref("supplier"))]),
        Param("shipping", "date", [Target(2, "date", {"lo": "ship_start", "hi": "ship_end"})]),
        Param("any-flag", "token", [Target(0, "token", {"code": "status", "system": None}), Target(1, "token", {"code": "return_flag", "system": None})])]),
    "Part": Resource("Part", [Table("part")], params=[
        Param("name", "string", [Target(0, "string", _str("name"))]), Param("price", "number", [Target(0, "number", {"col": "price"})]),
        Param("size", "quantity", [Target(0, "quantity", {"col": "size", "system": "brand", "code": "kind"})])]),
    "Supplier": Resource("Supplier", [Table("supplier")], params=[Param("nation", "reference", [Target(0, "reference", _ref("nation"))])]),
    "Event": Resource("Event", [Table("event")], params=[
        Param("type", "token", [Target(0, "token", {"code": "type", "system": None})]), Param("date", "date", [Target(0, "date", {"lo": "last_updated", "hi": None})]),
        Param("value", "number", [Target(0, "number", {"col": "value"})])]),
    "Document": Resource("Document", [Table("document"), Table("label", "elem")], params=[
        Param("text", "string", [Target(0, "string", _str("text"))]), Param("origin", "token", [Target(0, "token", {"code": "source", "system": "lang"})]),
        Param("good", "token", [Target(1, "token", {"code": "good", "system": None})])]),
    "Page": Resource("Page", [Table("page")], params=[
        Param("url", "uri", [Target(0, "uri", {"col": "url"})]), Param("address", "reference", [Target(0, "reference", _ref("address"))])]),
})


class Star:
    """Gives the map's tables over Parquet at ``path``; every table is a lazy projection of its scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        return getattr(self, f"_{name}")()

    @staticmethod
    def _id(column: str) -> F.Column:
        return F.col(column).cast("string")

    def _key(self, column: str) -> list[F.Column]:
        """The id as text, and the number that it is the text of, by which filters reach the files."""
        return [self._id(column).alias("id"), F.col(column).alias("id_key")]

    def _to(self, name: str, kind: str, column: str) -> list[F.Column]:
        return [F.lit(kind).alias(f"{name}_ref_type"), self._id(column).alias(f"{name}_ref_id"), F.col(column).alias(f"{name}_ref_id_key"), F.lit(None).cast("string").alias(f"{name}_ref_url")]

    def _region(self) -> DataFrame:
        return self.raw("region").select(*self._key("r_regionkey"), F.col("r_name").alias("name"), folded(F.col("r_name")).alias("name_norm"))

    def _nation(self) -> DataFrame:
        return self.raw("nation").select(*self._key("n_nationkey"), F.col("n_name").alias("name"), folded(F.col("n_name")).alias("name_norm"), *self._to("region", "Region", "n_regionkey"))

    def _customer(self) -> DataFrame:
        return self.raw("customer").select(
            *self._key("c_custkey"), F.col("c_name").alias("name"), folded(F.col("c_name")).alias("name_norm"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"), *self._to("nation", "Nation", "c_nationkey"),
        )

    def _supplier(self) -> DataFrame:
        return self.raw("supplier").select(*self._key("s_suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), *self._to("nation", "Nation", "s_nationkey"))

    def _part(self) -> DataFrame:
        return self.raw("part").select(
            *self._key("p_partkey"), F.col("p_name").alias("name"), folded(F.col("p_name")).alias("name_norm"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        )

    def _orders(self) -> DataFrame:
        parts = F.split("o_orderpriority", "-", 2)
        # 4-NOT SPECIFIED has no system: it stands for an unqualified code
        return self.raw("orders").select(
            *self._key("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("date"),
            F.when(parts[0] != "4", parts[0]).alias("priority_system"), parts[1].alias("priority_code"), *self._to("customer", "Customer", "o_custkey"),
        )

    def _order_item(self) -> DataFrame:
        return self.raw("lineitem").select(
            self._id("l_orderkey").alias("rid"), F.col("l_linenumber").alias("line_number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"),
            F.col("l_shipdate").alias("ship_date"), *self._to("part", "Part", "l_partkey"), *self._to("supplier", "Supplier", "l_suppkey"),
        )

    def numbered_items(self) -> DataFrame:
        """Items with their ordinal: line numbers repeat, so all columns decide, in a fixed order."""
        by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        return self.raw("lineitem").withColumn("ord", F.row_number().over(by))

    def _order_period(self) -> DataFrame:
        """When an order ships; orders with open items, status O, have no end."""
        span = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship_start"), F.max("l_shipdate").alias("ship_end"))
        orders = self.raw("orders").select("o_orderkey", "o_orderstatus")
        both = orders.join(span, orders.o_orderkey == span.l_orderkey, "left")
        return both.select(self._id("o_orderkey").alias("rid"), "ship_start", F.when(F.col("o_orderstatus") != "O", F.col("ship_end")).alias("ship_end"))

    def _event(self) -> DataFrame:
        return self.raw("events").select(*self._key("event_id"), F.col("ts").alias("last_updated"), F.col("event_type").alias("type"), "value", *self._to("user", "User", "user_id"))

    def _document(self) -> DataFrame:
        return self.raw("documents").select(*self._key("doc_id"), "text", folded(F.col("text")).alias("text_norm"), F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "source")

    def _label(self) -> DataFrame:
        return self.raw("labels").select(self._id("doc_id").alias("rid"), (F.col("quality") == 1).alias("good"))

    def _page(self) -> DataFrame:
        return self.raw("pages").select(
            *self._key("page_id"), "url", F.lit(None).cast("string").alias("address_ref_type"), F.lit(None).cast("string").alias("address_ref_id"), F.col("url").alias("address_ref_url"),
        )
