"""Queries on documents as rows, versions, integrity, logs and schemas; each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import refs, temporal
from docweave.functions.digests import linked
from docweave.functions.leaves import JsonLeaves
from docweave.functions.text import folded
from docweave.operators import integrity, reconstruct, shred
from docweave.plans import evolve
from docweave.plans.generate import build_map, load_spec
from docweave.plans.model import RelMap
from docweave.plans.search_compile import support_matrix
from docweave.plans.star import MAP, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


# --- orders as nested documents ---


def _element(path: str, kind: str, many: bool = False) -> dict:
    return {"path": path, "max": "*" if many else "1"} | ({"type": [{"code": kind}]} if kind else {})


@lru_cache(maxsize=1)
def order_map() -> RelMap:
    primitives = [{"kind": "primitive-type", "name": p} for p in ("string", "code", "decimal", "integer", "dateTime", "uri")]
    reference = {"kind": "complex-type", "name": "Reference", "snapshot": {"element": [_element("Reference.reference", "string"), _element("Reference.display", "string")]}}
    fields = [_element("Order.status", "code"), _element("Order.total", "decimal"), _element("Order.date", "dateTime"), _element("Order.customer", "Reference"), _element("Order.tag", "string", True), _element("Order.item", "", True)]
    item = [_element(f"Order.item.{n}", k) for n, k in (("number", "integer"), ("quantity", "decimal"), ("price", "decimal"), ("flag", "code"), ("part", "Reference"))]
    return build_map(load_spec([*primitives, reference, {"kind": "resource", "name": "Order", "snapshot": {"element": fields + item}}]), "orders")


def order_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, body): each order with its items in order; an order without items has no such element."""
    star = Star(spark, path)
    # line numbers repeat, so all columns decide the order, as in numbered_items()
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    items = star.raw("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"))
    item = lambda x: F.struct(x["l_linenumber"].alias("number"), x["l_quantity"].alias("quantity"), x["l_extendedprice"].alias("price"), x["l_returnflag"].alias("flag"), F.struct(F.concat(F.lit("Part/"), x["l_partkey"]).alias("reference")).alias("part"))
    orders = star.raw("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    document = F.struct(
        F.lit("Order").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.struct(F.concat(F.lit("Customer/"), F.col("o_custkey")).alias("reference")).alias("customer"),
        F.split("o_orderpriority", "-").alias("tag"), F.transform("all", item).alias("item"),
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), F.to_json(document).alias("body"))


def _shredded(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    rows = shred.tagged(order_documents(spark, path), order_map(), only=names)
    return [shred.table_of(rows, t) for n in names for t in order_map().resources["Order"].tables if t.name == n]


@_query("shred_base", "SELECT cast(o_orderkey AS varchar) AS id, o_orderstatus AS status, cast(o_totalprice AS decimal(18,2))::double AS total, o_orderdate AS date, 'Customer' AS customer_ref_type, cast(o_custkey AS varchar) AS customer_ref_id, cast(NULL AS varchar) AS customer_ref_url FROM orders")
def shred_base(spark: SparkSession, path: str) -> DataFrame:
    (base,) = _shredded(spark, path, "order")
    return base.select("id", "status", F.col("total_num").cast("double").alias("total"), F.col("date_sort").cast("timestamp_ntz").alias("date"), "customer_ref_type", "customer_ref_id", "customer_ref_url")


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM lineitem)"


@_query("shred_child_ordinals", f"SELECT cast(l_orderkey AS varchar) AS rid, cast(ord AS integer) AS ord, l_linenumber AS number, l_quantity AS quantity, l_returnflag AS flag, cast(l_partkey AS varchar) AS part_ref_id FROM {NUMBERED}")
def shred_child_ordinals(spark: SparkSession, path: str) -> DataFrame:
    (items,) = _shredded(spark, path, "order_item")
    return items.select("rid", F.col("ords")[0].cast("int").alias("ord"), "number", F.col("quantity_num").cast("double").alias("quantity"), "flag", "part_ref_id")


@_query("shred_primitive_array", "SELECT cast(o_orderkey AS varchar) AS rid, cast(i AS integer) AS ord, split_part(o_orderpriority, '-', i) AS value FROM orders, (VALUES (1), (2)) t(i)")
def shred_primitive_array(spark: SparkSession, path: str) -> DataFrame:
    (tags,) = _shredded(spark, path, "order_tag")
    return tags.select("rid", F.col("ords")[0].cast("int").alias("ord"), "value")


@_query("shred_errors", "SELECT 'item.part: is not an object' AS error, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def shred_errors(spark: SparkSession, path: str) -> DataFrame:
    """Documents that don't fit: every part is text here, so every order with items is refused."""
    docs = order_documents(spark, path).withColumn("body", F.regexp_replace("body", r'"part":\{[^}]*\}', '"part":"x"'))
    return shred.errors(shred.tagged(docs, order_map())).groupBy("error").agg(F.count("*").alias("n"))


@_query("roundtrip_diff", "SELECT count(*) AS n_documents, 0 AS n_errors, 0 AS n_different FROM orders")
def roundtrip_diff(spark: SparkSession, path: str) -> DataFrame:
    """Documents to rows to documents: how many come back otherwise than they were."""
    docs = order_documents(spark, path)
    tables, _ = shred.shred(docs, order_map())
    back = reconstruct.reconstruct(tables, order_map(), "Order")
    both = docs.join(back.select("id", F.col("body").alias("again"), "error"), "id", "left")
    # both texts name their elements in the map's order
    return both.agg(
        F.count("*").alias("n_documents"), F.sum(F.col("error").isNotNull().cast("int")).cast("int").alias("n_errors"),
        F.sum((~F.col("body").eqNullSafe(F.col("again"))).cast("int")).cast("int").alias("n_different"),
    )


@_query("reconstruct_order_docs", f"SELECT cast(o_orderkey AS varchar) AS id, o_orderstatus AS status, count(l_orderkey) AS n_items, coalesce(string_agg(l_partkey || 'x' || cast(l_quantity AS integer), ',' ORDER BY ord), '') AS items FROM orders LEFT JOIN {NUMBERED} ON l_orderkey = o_orderkey GROUP BY 1, 2")
def reconstruct_order_docs(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilt documents, read back as typed values."""
    tables, _ = shred.shred(order_documents(spark, path), order_map())
    back = reconstruct.reconstruct(tables, order_map(), "Order")
    kind = "struct<status:string,item:array<struct<quantity:double,part:struct<reference:string>>>>"
    doc = back.select("id", F.from_json("body", kind).alias("d"))
    items = F.transform("d.item", lambda x: F.concat(F.substring_index(x["part"]["reference"], "/", -1), F.lit("x"), x["quantity"].cast("int")))
    return doc.select("id", "d.status", F.coalesce(F.size("d.item"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(items, ","), F.lit("")).alias("items"))


@_query("ordinal_gap_check", "SELECT cast(conv_id AS varchar) AS rid, count(*) AS n, cast(max(turn + 1) AS integer) AS most FROM conversations WHERE turn <> 1 GROUP BY 1 HAVING count(*) <> max(turn + 1)")
def ordinal_gap_check(spark: SparkSession, path: str) -> DataFrame:
    turns = Star(spark, path).raw("conversations").where("turn <> 1").select(F.col("conv_id").cast("string").alias("rid"), F.array((F.col("turn") + 1).cast("smallint")).alias("ords"))
    return reconstruct.ordinal_gaps(turns).select("rid", "n", F.col("most").cast("int").alias("most"))


@_query("orphan_check", "SELECT cast(l_orderkey AS varchar) AS rid, l_linenumber AS line_number, l_quantity AS quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def orphan_check(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return reconstruct.orphans(star("order_item"), star("orders").where("status <> 'P'")).select("rid", "line_number", "quantity")


# --- values ---


@_query("shred_ref_split", "SELECT cast(page_id AS varchar) AS id, CASE WHEN page_id % 3 = 0 THEN 'Page' END AS ref_type, CASE WHEN page_id % 3 = 0 THEN cast(page_id AS varchar) END AS ref_id, CASE WHEN page_id % 3 = 1 THEN url WHEN page_id % 3 = 2 THEN '#' || page_id END AS ref_url FROM pages")
def shred_ref_split(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("page_id") % 3
    value = F.when(k == 0, F.concat(F.lit("Page/"), "page_id")).when(k == 1, F.col("url")).otherwise(F.concat(F.lit("#"), "page_id"))
    kind, id_, url = refs.split(value)
    return Star(spark, path).raw("pages").select(F.col("page_id").cast("string").alias("id"), kind.alias("ref_type"), id_.alias("ref_id"), url.alias("ref_url"))


@_query("reference_rejoin", "SELECT cast(o_orderkey AS varchar) AS id, 'Customer/' || o_custkey AS reference FROM orders")
def reference_rejoin(spark: SparkSession, path: str) -> DataFrame:
    return Star(spark, path)("orders").select("id", refs.join(F.col("customer_ref_type"), F.col("customer_ref_id"), F.col("customer_ref_url")).alias("reference"))


@_query("shred_temporal_sort", "SELECT cast(o_orderkey AS varchar) AS id, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END::date::varchar AS day, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END::timestamp AS instant FROM orders")
def shred_temporal_sort(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    value = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = Star(spark, path).raw("orders").select(F.col("o_orderkey").cast("string").alias("id"), value.alias("v"))
    return rows.select("id", temporal.date_sort(F.col("v")).cast("string").alias("day"), temporal.datetime_sort(F.col("v")).cast("timestamp_ntz").alias("instant"))


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    spark.udtf.register("json_leaves", JsonLeaves)
    return spark.sql("SELECT cast(event_id AS string) AS id, l.* FROM {events}, LATERAL json_leaves(props) l", events=Star(spark, path).raw("events").select("event_id", "props"))


@_query("shred_leaves", "SELECT cast(event_id AS varchar) AS id, 'k' AS leaf, 'n' AS v_kind, json_extract_string(props, '$.k') AS v_text FROM events")
def shred_leaves(spark: SparkSession, path: str) -> DataFrame:
    return _leaves(spark, path)


@_query("ext_leaf_lookup", "SELECT cast(event_id AS varchar) AS id, event_type AS type, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events WHERE cast(json_extract_string(props, '$.k') AS integer) > 90")
def ext_leaf_lookup(spark: SparkSession, path: str) -> DataFrame:
    hits = _leaves(spark, path).where("leaf = 'k' and v_kind = 'n'").select("id", F.col("v_text").cast("int").alias("k")).where("k > 90")
    return Star(spark, path)("event").join(hits, "id").select("id", "type", "k")


@_query("shred_norm", "SELECT cast(doc_id AS varchar) AS id, md5(strip_accents(lower(text))) AS norm FROM documents")
def shred_norm(spark: SparkSession, path: str) -> DataFrame:
    return Star(spark, path)("document").select("id", F.md5("text_norm").alias("norm"))


# --- versions ---

VERSIONS = """(SELECT cast(user_id AS varchar) AS id, version_id, ts, CASE WHEN version_id = 1 THEN 'C' WHEN last AND event_type = 'error' THEN 'D' ELSE 'U' END AS op, event_type, value, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AS last FROM events))"""


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Each user's events as the versions of one document; a last event of type error deletes it."""
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = Star(spark, path).raw("events").withColumn("version_id", F.row_number().over(w).cast("long")).withColumn("next", F.lead("ts").over(w))
    op = F.when(F.col("version_id") == 1, "C").when(F.col("next").isNull() & (F.col("event_type") == "error"), "D").otherwise("U")
    return rows.select(F.col("user_id").cast("string").alias("id"), "version_id", "ts", op.alias("op"), "event_type", "value", "event_id")


@_query("conditional_create_outcome", "SELECT s.segment, s.nation, CASE count(c_custkey) WHEN 0 THEN 'created' WHEN 1 THEN 'existing' ELSE 'multiple' END AS outcome FROM (SELECT DISTINCT c_mktsegment AS segment, n_nationkey AS nation FROM customer, nation) s LEFT JOIN customer ON c_mktsegment = segment AND c_nationkey = nation AND c_acctbal > 8000 GROUP BY 1, 2")
def conditional_create_outcome(spark: SparkSession, path: str) -> DataFrame:
    """What a conditional create would do for each segment and nation, as one join."""
    star = Star(spark, path)
    rich = star.raw("customer").where("c_acctbal > 8000").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    segments = star.raw("customer").select(F.col("c_mktsegment").alias("segment")).distinct().agg(F.collect_set("segment").alias("all"))
    asked = star.raw("nation").select(F.col("n_nationkey").alias("nation")).join(F.broadcast(segments)).select("nation", F.explode("all").alias("segment"))  # one row of five segments
    outcome = F.when(F.col("n").isNull(), "created").when(F.col("n") == 1, "existing").otherwise("multiple")
    return asked.join(rich, ["segment", "nation"], "left").select("segment", "nation", outcome.alias("outcome"))


# --- integrity ---

KEY = ("k1", bytes(range(32)))
IMAGE = "id || '|' || version_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || op || '|' || event_type || '|user'"
CHAIN = f"""WITH RECURSIVE v AS (SELECT *, {IMAGE} AS image FROM {VERSIONS}), c AS (
  SELECT id, version_id, sha256(unhex(repeat('00', 32)) || encode(image)) AS h FROM v WHERE version_id = 1
  UNION ALL SELECT v.id, v.version_id, sha256(unhex(c.h) || encode(v.image)) FROM v JOIN c ON v.id = c.id AND v.version_id = c.version_id + 1) """


def chained(spark: SparkSession, path: str) -> DataFrame:
    """The versions as a history with both chains and tags."""
    rows = versions(spark, path).select(
        F.lit("User").alias("rtype"), "id", "version_id", F.col("ts").cast("timestamp").alias("last_updated"), "op", F.col("event_type").alias("resource"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("reason"),
    )
    none = F.lit(None).cast("binary")
    return linked(rows.withColumns({"image": integrity.image(rows), "last": none, "last3": none}), KEY).drop("image", "last", "last3")


@_query("chain_sha256", CHAIN + "SELECT id, version_id, h AS row_hash FROM c")
def chain_sha256(spark: SparkSession, path: str) -> DataFrame:
    return chained(spark, path).select("id", "version_id", F.lower(F.hex("row_hash")).alias("row_hash"))


@_query("chain_sha3")
def chain_sha3(spark: SparkSession, path: str) -> DataFrame:
    return chained(spark, path).select("id", "version_id", F.lower(F.hex("row_hash3")).alias("row_hash3"))


@_query("chain_hmac")
def chain_hmac(spark: SparkSession, path: str) -> DataFrame:
    return chained(spark, path).select("id", "version_id", "row_mac")


@_query("chain_verify_tampered", f"SELECT id, version_id, what FROM {VERSIONS}, (VALUES ('sha256'), ('sha3-256'), ('mac')) w(what) WHERE version_id = 5 AND cast(id AS integer) % 10 = 0")
def chain_verify_tampered(spark: SparkSession, path: str) -> DataFrame:
    history = chained(spark, path).withColumn("resource", F.when((F.col("version_id") == 5) & (F.col("id").cast("int") % 10 == 0), "forged").otherwise(F.col("resource")))
    return integrity.verify(history, dict([KEY])).select("id", "version_id", "what")


@_query("chain_witness", CHAIN + """, heads AS (SELECT id, 'User|' || id AS who, max(version_id) AS n, arg_max(h, version_id) AS h FROM c GROUP BY 1),
g AS (SELECT cast('0x' || substr(sha256(who), 1, 8) AS bigint) % 4096 AS g, count(*) AS n, sha256(string_agg(who || '|' || n || '|' || upper(h), chr(10) ORDER BY who || '|' || n || '|' || upper(h))) AS d FROM heads GROUP BY 1)
SELECT cast(sum(n) AS bigint) || ':' || sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS witness FROM g""")
def chain_witness(spark: SparkSession, path: str) -> DataFrame:
    return integrity.witness(chained(spark, path))


@_query("resign_append", f"SELECT id, version_id, 'auditor' AS actor, 'k2' AS key FROM {VERSIONS}")
def resign_append(spark: SparkSession, path: str) -> DataFrame:
    signatures = spark.createDataFrame([], "rtype string, id string, version_id long, row_mac string, signed_at timestamp, actor string, reason string")
    ring = integrity.KeyRing(KEY).rotated(("k2", bytes(range(1, 33))))
    made = integrity.resign(chained(spark, path), signatures, ring, F.current_timestamp(), "auditor", "rotation")
    return made.select("id", "version_id", "actor", F.substring_index("row_mac", ":", 1).alias("key"))


@_query("purge_tombstone", f"SELECT id, version_id, op FROM {VERSIONS} WHERE cast(id AS integer) % 7 <> 0 UNION ALL SELECT id, max(version_id) + 1, 'X' FROM {VERSIONS} WHERE cast(id AS integer) % 7 = 0 GROUP BY 1")
def purge_tombstone(spark: SparkSession, path: str) -> DataFrame:
    history = chained(spark, path)
    gone = history.where(F.col("id").cast("int") % 7 == 0).select("rtype", "id").distinct()
    return integrity.purge(history, gone, F.current_timestamp(), "officer", "request").select("id", "version_id", "op")


# --- logs and schemas ---


@_query("fold_backfill", "SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_custkey % 5 = 0 THEN 'kept' ELSE lower(c_mktsegment) END AS segment_norm FROM customer")
def fold_backfill(spark: SparkSession, path: str) -> DataFrame:
    rows = Star(spark, path).raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 5 == 0, "kept").alias("segment_norm"))
    return evolve.backfill(rows, "segment", "segment_norm")


OLD = [("patient", "active", "boolean"), ("patient", "gender", "string"), ("patient_name", "family", "string"), ("basic", "id", "string")]
NEW = [("patient", "active", "boolean"), ("patient", "gender", "int"), ("patient_name", "family", "string"), ("patient_name", "family_norm", "string")]


@_query("catalog_diff", "SELECT * FROM (VALUES ('patient', 'gender', 'changed', 'string', 'int'), ('patient_name', 'family_norm', 'added', NULL, 'string'), ('basic', 'id', 'removed', 'string', NULL)) t(table_name, column_name, change, old_type, new_type)")
def catalog_diff(spark: SparkSession, path: str) -> DataFrame:
    kind = "table_name string, column_name string, type string"
    return evolve.diff(spark.createDataFrame(OLD, kind), spark.createDataFrame(NEW, kind))


@_query("support_matrix", "SELECT * FROM (VALUES ('Customer', 'balance', 'number', true, ''), ('Customer', 'name', 'string', true, ''), ('Customer', 'nation', 'reference', true, ''), ('Customer', 'segment', 'token', true, ''), ('Customer', 'special', 'composite', false, 'a composite parameter has no path of its own'), ('Region', 'name', 'string', true, '')) t(type, code, kind, compiled, note)")
def support(spark: SparkSession, path: str) -> DataFrame:
    rows = [r for r in support_matrix(MAP) if r[0] in ("Customer", "Region")]
    return spark.createDataFrame(rows, "type string, code string, kind string, compiled boolean, note string")


@_query("table_columns", f"SELECT * FROM (VALUES {', '.join(str(x) for x in (('order', 'id', 'string'), ('order_item', 'ords', 'array<smallint>'), ('order_item', 'quantity', 'string'), ('order_item', 'quantity_num', 'decimal(38,18)'), ('order', 'date_sort', 'timestamp')))}) t(table_name, column_name, type)")
def table_columns(spark: SparkSession, path: str) -> DataFrame:
    wanted = F.concat_ws(".", "table_name", "column_name").isin("order.id", "order_item.ords", "order_item.quantity", "order_item.quantity_num", "order.date_sort")
    return evolve.catalog(spark, order_map()).where(wanted)


@_query("fold_words", "SELECT DISTINCT lang, strip_accents(lower(w)) AS word FROM (SELECT lang, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE length(w) > 12")
def fold_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct folded words: folded after they are made distinct."""
    docs = Star(spark, path).raw("documents")
    words = docs.select("lang", F.explode(F.split("text", r"\s+")).alias("w")).where(F.length("w") > 12).distinct()
    return words.select("lang", folded(F.col("w")).alias("word")).distinct()
