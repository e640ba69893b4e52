"""Search queries on the star tables: predicates, joins, sorting, paging, includes; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.search import Request, Searcher
from docweave.plans.star import MAP, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _searcher(spark: SparkSession, path: str) -> Searcher:
    return Searcher(MAP, Star(spark, path))


def _search(name: str, kind: str, query: str, sql: str) -> None:
    """All matches' ids."""
    QUERIES[name] = lambda spark, path: _searcher(spark, path).matches(kind, Request.parse(query).criteria).select("id")
    ORACLES[name] = sql


def _query(name: str, sql: str) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return keep


ORDER, PART, CUSTOMER = "SELECT cast(o_orderkey AS varchar) AS id FROM orders WHERE ", "SELECT cast(p_partkey AS varchar) AS id FROM part WHERE ", "SELECT cast(c_custkey AS varchar) AS id FROM customer WHERE "
DOC, EVENT = "SELECT cast(doc_id AS varchar) AS id FROM documents WHERE ", "SELECT cast(event_id AS varchar) AS id FROM events WHERE "
ITEM = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"

# --- ids, tokens, strings ---

_search("search_id_or", "Customer", "_id=3,17,99999999,40", CUSTOMER + "c_custkey IN (3, 17, 99999999, 40)")
_search("token_bare", "Order", "status=F", ORDER + "o_orderstatus = 'F'")
_search("token_or", "Order", "status=F,P", ORDER + "o_orderstatus IN ('F', 'P')")
_search("token_bool_cast", "Document", "good=true", "SELECT cast(doc_id AS varchar) AS id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)")
_search("token_system_code", "Order", "priority=1|URGENT", ORDER + "o_orderpriority = '1-URGENT'")
_search("token_system_only", "Order", "priority=2|", ORDER + "o_orderpriority LIKE '2-%'")
_search("token_null_system", "Document", "origin=|src3", DOC + "lang = 'en' AND source = 'src3'")
_search("token_no_system_column", "Order", "status=x|F,|P", ORDER + "o_orderstatus = 'P'")
_search("string_prefix_folded", "Document", "text=the%20and", DOC + "starts_with(strip_accents(lower(text)), 'the and')")
_search("string_prefix_accents", "Document", "text=%C3%88", DOC + "starts_with(strip_accents(lower(text)), 'e')")
_search("string_exact", "Customer", "name:exact=Customer%23000000042", CUSTOMER + "c_name = 'Customer#000000042'")
_search("string_contains_folded", "Document", "text:contains=PA%C3%89", DOC + "contains(strip_accents(lower(text)), 'pae')")
_search("string_contains_wildcards", "Document", "text:contains=%25%25%25", DOC + "contains(text, '%%%')")

# --- numbers and quantities ---

for op, sign in {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "ge": ">=", "le": "<="}.items():
    _search(f"number_{op}", "Part", f"price={op}950", PART + f"p_retailprice {sign} 950")
_search("quantity_value_unit", "Part", "size=gt20||SMALL", PART + "p_size > 20 AND p_type = 'SMALL'")
_search("quantity_system_unit", "Part", "size=le30|Brand%2311", PART + "p_size <= 30 AND p_brand = 'Brand#11'")

# --- dates and periods ---

_search("date_year", "Order", "date=1997", ORDER + "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_search("date_month", "Order", "date=1996-12", ORDER + "o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
_search("date_day", "Order", "date=1996-02-29", ORDER + "o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '1996-03-01'")
_search("date_instant", "Event", "date=2024-01-01T00:03:52Z,2024-01-01T00:00:07Z", EVENT + "ts BETWEEN TIMESTAMP '2024-01-01 00:03:52' AND TIMESTAMP '2024-01-01 00:03:52.999999' OR ts BETWEEN TIMESTAMP '2024-01-01 00:00:07' AND TIMESTAMP '2024-01-01 00:00:07.999999'")
_search("date_ne", "Order", "date=ne1997", ORDER + "NOT (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')")
_search("date_lt_eb", "Order", "date=lt1996,eb1995-06", ORDER + "o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate < TIMESTAMP '1995-06-01'")
_search("date_gt_sa", "Order", "date=gt1998-06&date=sa1998", ORDER + "o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate >= TIMESTAMP '1999-01-01'")
_search("date_ge", "Order", "date=ge1998-07-15", ORDER + "o_orderdate >= TIMESTAMP '1998-07-15'")
_search("date_le", "Order", "date=le1995-03", ORDER + "o_orderdate < TIMESTAMP '1995-04-01'")
_search("date_offset", "Event", "date=ge2024-01-20T02:00:00%2B02:00", EVENT + "ts >= TIMESTAMP '2024-01-20 00:00:00'")
_search("last_updated_range", "Event", "_lastUpdated=ge2024-01-10&_lastUpdated=lt2024-01-12", EVENT + "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
PERIOD = """SELECT id FROM (
  SELECT cast(o_orderkey AS varchar) AS id, s AS lo, CASE WHEN o_orderstatus <> 'O' THEN e END AS hi FROM orders
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE """
_search("period_overlap", "Order", "shipping=1997-02", PERIOD + "lo < TIMESTAMP '1997-03-01' AND (hi IS NULL OR hi >= TIMESTAMP '1997-02-01')")
_search("period_open_end", "Order", "shipping=gt1998", PERIOD + "(lo IS NOT NULL OR hi IS NOT NULL) AND (hi IS NULL OR hi >= TIMESTAMP '1999-01-01')")
_search("period_ge", "Order", "shipping=ge1999-06", PERIOD + "(lo IS NOT NULL OR hi IS NOT NULL) AND (hi IS NULL OR hi >= TIMESTAMP '1999-06-01')")
_search("period_ne", "Order", "shipping=ne1997", PERIOD + "NOT (lo < TIMESTAMP '1998-01-01' AND (hi IS NULL OR hi >= TIMESTAMP '1997-01-01')) AND (lo IS NOT NULL OR hi IS NOT NULL)")

# --- references ---

_search("ref_typed", "Order", "customer=Customer/7", ORDER + "o_custkey = 7")
_search("ref_bare", "Order", "customer=11", ORDER + "o_custkey = 11")
_search("ref_type_modifier", "Order", "customer:Customer=12,13", ORDER + "o_custkey IN (12, 13)")
_search("ref_other_type", "Order", "customer=Supplier/7", ORDER + "false")
_search("ref_url", "Page", "address=http://ththre.example.com/fr/825%3Fpage%3D2%26ref%3Dx", "SELECT cast(page_id AS varchar) AS id FROM pages WHERE url = 'http://ththre.example.com/fr/825?page=2&ref=x'")
_search("uri_exact", "Page", "url=http://ththre.example.com/fr/825%3Fpage%3D2%26ref%3Dx", "SELECT cast(page_id AS varchar) AS id FROM pages WHERE url = 'http://ththre.example.com/fr/825?page=2&ref=x'")

# --- joins ---

_search("child_semijoin", "Order", "item-quantity=gt49", ORDER + ITEM.format("l_quantity > 49"))
_search("child_ne_semantics", "Order", "item-date=ne1997", ORDER + ITEM.format("NOT (l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01')"))
_search("or_exists_targets", "Order", "any-flag=P,R", ORDER + "o_orderstatus IN ('P', 'R') OR " + ITEM.format("l_returnflag IN ('P', 'R')"))
_search("and_params", "Order", "status=F&item-quantity=ge48&item-flag=O|R,F|A&date=lt1999", ORDER + "o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01' AND " + ITEM.format("l_quantity >= 48") + " AND " + ITEM.format("((l_linestatus = 'O' AND l_returnflag = 'R') OR (l_linestatus = 'F' AND l_returnflag = 'A'))"))
_search("chain_base", "Order", "customer:Customer.segment=BUILDING", ORDER + "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
_search("chain_child", "Order", "part:Part.price=gt990", ORDER + ITEM.format("EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_retailprice > 990)"))
_search("chain_string", "Customer", "nation:Nation.name=nation_1", CUSTOMER + "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND starts_with(lower(n_name), 'nation_1'))")


def _page(name: str, kind: str, query: str, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, path: _searcher(spark, path).page(kind, Request.parse(query)).select(*columns)
    ORACLES[name] = sql


SEL = "SELECT cast(o_orderkey AS varchar) AS id, o_orderstatus AS status, o_totalprice AS total FROM orders "
_page("search_flagship", "Order", "status=F&date=ge1997&item-quantity=gt45&_sort=-total&_count=20", ["id", "status", "total", "date"],
      "SELECT cast(o_orderkey AS varchar) AS id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS date FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' AND " + ITEM.format("l_quantity > 45") + " ORDER BY o_totalprice DESC NULLS LAST, id LIMIT 20")
_page("sort_multi_nulls_last", "Order", "_sort=-priority,total&_count=100", ["id", "priority_code", "priority_system", "total"],
      "SELECT cast(o_orderkey AS varchar) AS id, substr(o_orderpriority, 3) AS priority_code, CASE WHEN o_orderpriority NOT LIKE '4%' THEN substr(o_orderpriority, 1, 1) END AS priority_system, o_totalprice AS total FROM orders ORDER BY priority_code DESC NULLS LAST, total ASC NULLS LAST, id LIMIT 100")
_page("page_offset", "Order", "status=O&_sort=total&_count=50&_offset=100", ["id", "status", "total"], SEL + "WHERE o_orderstatus = 'O' ORDER BY o_totalprice NULLS LAST, id LIMIT 50 OFFSET 100")
_page("page_cursor", "Order", "status=O&_cursor=2500&_count=50", ["id", "status", "total"], SEL + "WHERE o_orderstatus = 'O' AND cast(o_orderkey AS varchar) > '2500' ORDER BY id LIMIT 50")
_page("page_default_size", "Order", "", ["id", "status", "total"], SEL + "ORDER BY id LIMIT 50")
_page("page_most", "Order", "_count=5000&_sort=_id", ["id", "status", "total"], SEL + "ORDER BY id LIMIT 1000")


@_query("scan_ids", "SELECT cast(c_custkey AS varchar) AS id FROM customer ORDER BY id")
def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    return Star(spark, path)("customer").select("id").orderBy("id")


@_query("total_count", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND " + ITEM.format("l_quantity > 45"))
def total_count(spark: SparkSession, path: str) -> DataFrame:
    return _searcher(spark, path).total("Order", Request.parse("status=F&item-quantity=gt45&_cursor=5&_count=1"))


TOP = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, cast(o_orderkey AS varchar) LIMIT 40)"


def _included(query: str, most: int = 1000) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, path: str) -> DataFrame:
        s, request = _searcher(spark, path), Request.parse(query)
        return s.included("Order", request, s.page("Order", request), most)

    return run


QUERIES["include_forward"] = _included("status=P&_sort=-total&_count=40&_include=Order:customer&_include=Order:part")
ORACLES["include_forward"] = f"""WITH m AS {TOP} SELECT type, id, false AS truncated FROM (
  SELECT 'Customer' AS type, cast(o_custkey AS varchar) AS id FROM m UNION
  SELECT 'Part', cast(l_partkey AS varchar) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM m))"""
QUERIES["include_dedup_cap"] = _included("status=P&_sort=-total&_count=40&_include=Order:part&_include=Order:part&_include=Order:supplier", 30)
ORACLES["include_dedup_cap"] = f"""WITH m AS {TOP} SELECT type, id, true AS truncated FROM (
  SELECT 'Part' AS type, cast(l_partkey AS varchar) AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM m) UNION
  SELECT 'Supplier', cast(l_suppkey AS varchar) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM m)) ORDER BY type, id LIMIT 30"""


@_query("revinclude", "WITH m AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY cast(c_custkey AS varchar) LIMIT 25) SELECT 'Order' AS type, cast(o_orderkey AS varchar) AS id, false AS truncated FROM orders WHERE o_custkey IN (SELECT c_custkey FROM m)")
def revinclude(spark: SparkSession, path: str) -> DataFrame:
    s, request = _searcher(spark, path), Request.parse("segment=MACHINERY&_count=25&_revinclude=Order:customer")
    return s.included("Customer", request, s.page("Customer", request))


@_query("readme_family_counts", "SELECT c_mktsegment AS segment, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def readme_family_counts(spark: SparkSession, path: str) -> DataFrame:
    """SQL over the tables, joined by a reference's type and id."""
    star = Star(spark, path)
    c, o = star("customer"), star("orders")
    both = o.join(c, (o.customer_ref_type == "Customer") & (o.customer_ref_id == c.id))
    return both.groupBy("segment").agg(F.count("*").alias("n_orders"), F.countDistinct(c.id).alias("n_customers"))
