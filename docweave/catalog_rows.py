"""Queries on documents with every kind of element as rows, and back: choices, extensions, twins, spills, recursion."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog_documents import _element
from docweave.functions import leaves, naming
from docweave.operators import reconstruct, shred, validate
from docweave.operators.predicates import UnsupportedSearch
from docweave.operators.search import Request, Searcher
from docweave.plans import evolve
from docweave.plans.generate import load_spec
from docweave.plans.model import RelMap
from docweave.plans.search_compile import add_folded, build_map, capability, compile_search, support_matrix
from docweave.plans.session import checkpoint, scratch, spread
from docweave.plans.star import Star
from docweave.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


PARAMETERS = [
    ("active", "token", "Thing.active"), ("born", "date", "Thing.born"), ("worth", "number", "(Thing.value as decimal)"), ("said", "string", "Thing.value.ofType(string)"), ("owner", "reference", "Thing.owner"), ("step", "string", "Thing.entry.text"),
    ("nick", "string", "Thing.nick"), ("both", "composite", "Thing"), ("far", "special", ""), ("lost", "token", "Thing.nowhere"), ("any", "token", "Thing.value"),
]


@lru_cache(maxsize=1)
def thing_map() -> RelMap:
    """A type with a choice, an array of primitives, a wide element, a way back into itself and one that recurs by type."""
    primitives = [{"kind": "primitive-type", "name": p} for p in ("boolean", "string", "code", "decimal", "integer", "integer64", "date", "dateTime")]

    def definition(name: str, kind: str, *fields: tuple) -> dict:
        return {"kind": kind, "name": name, "snapshot": {"element": [_element(f"{name}.{f}", *more) for f, *more in fields]}}

    value = {"path": "Thing.value[x]", "max": "1", "type": [{"code": "decimal"}, {"code": "string"}]}
    again = {"path": "Thing.entry.entry", "max": "*", "contentReference": "#Thing.entry"}
    thing = definition("Thing", "resource", ("contained", "Resource", True), ("active", "boolean"), ("born", "date"), ("seen", "dateTime"), ("big", "integer64"), ("amount", "decimal"), ("nick", "string", True), ("owner", "Reference"), ("box", "Outer"), ("wide", "Wide"), ("entry", "", True))
    thing["snapshot"]["element"] += [value, _element("Thing.entry.text", "string"), again]
    made = build_map(load_spec([
        *primitives, definition("Reference", "complex-type", ("reference", "string"), ("display", "string")), definition("Outer", "complex-type", ("label", "string"), ("inner", "Inner")),
        definition("Inner", "complex-type", ("note", "string"), ("outer", "Outer")), definition("Wide", "complex-type", *((f"f{i}", "string") for i in range(151))), thing,
    ]), "things")
    compile_search(made, [{"code": c, "type": t, "base": ["Thing"]} | ({"expression": e} if e else {}) for c, t, e in PARAMETERS])
    add_folded(made)
    return made


def things(spark: SparkSession, path: str) -> DataFrame:
    """(id, k, body): a document of every customer."""
    k = F.col("c_custkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    born = F.when(k % 3 == 0, "2001").when(k % 3 == 1, "2001-07").otherwise("2001-07-09")
    members = {
        "resourceType": F.lit('"Thing"'), "id": text(k), "active": F.when(k % 2 == 0, "true").otherwise("false"), "_active": F.when(k % 4 == 0, F.lit('{"id":"a","extension":[{"url":"why","valueString":"told"}]}')), "born": text(born), "seen": F.lit('"2020-02-29T23:30:00.5-02:00"'),
        "big": text(k.cast("long") * 1000000007), "amount": F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("0")), "valueDecimal": F.when(k % 2 == 0, F.concat(k, F.lit(".50"))), "valueString": F.when(k % 2 == 1, text(F.concat(F.lit("v"), k))),
        "nick": F.concat(F.lit('["a'), k, F.lit('",null,"Ç"]')), "_nick": F.lit('[null,{"id":"n2"},null]'), "owner": F.concat(F.lit('{"reference":"Nation/'), F.col("c_nationkey"), F.lit('","display":"d"}')),
        "contained": F.when(k % 5 == 0, F.lit('[{"resourceType":"Part","n":1.50},{"x":1e2}]')), "box": F.concat(F.lit('{"label":"l","inner":{"note":"n","outer":{"label":"deep'), k, F.lit('","n":[1,2.0]}}}')), "wide": F.concat(F.lit('{"f0":"zero","f150":"last'), k, F.lit('"}')),
        "entry": F.lit('[{"text":"1","entry":[{"text":"1.1"},{"text":"1.2","entry":[{"text":"1.2.1"}]}]},{"text":"2"}]'), "extension": F.concat(F.lit('[{"url":"e1","valueInteger":'), k, F.lit('},{"url":"e2","extension":[{"url":"in","valueBoolean":true}]}]')),
        "modifierExtension": F.when(k % 7 == 0, F.lit('[{"url":"m","valueCode":"not"}]')),
    }
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{n}":'), v)) for n, v in members.items()]
    return Star(spark, path).raw("customer").select(k.cast("string").alias("id"), k.alias("k"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("body"))


def _rows(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    rows = shred.tagged(things(spark, path), thing_map(), only=names)
    return [shred.table_of(rows, t) for n in names for t in thing_map().resources["Thing"].tables if t.name == n]


@_query("shred_choice", "SELECT c_custkey::varchar AS id, c_custkey % 2 = 0 AS active, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 0.5 END::double AS number, CASE WHEN c_custkey % 2 = 1 THEN 'v' || c_custkey END AS text, c_custkey * 1000000007 AS big FROM customer")
def shred_choice(spark: SparkSession, path: str) -> DataFrame:
    (base,) = _rows(spark, path, "thing")
    return base.select("id", "active", F.col("value_decimal_num").cast("double").alias("number"), F.col("value_string").alias("text"), "big")


@_query("shred_lexical", "SELECT c_custkey::varchar AS id, c_acctbal::decimal(18,2)::varchar || '0' AS amount, CASE c_custkey % 3 WHEN 0 THEN '2001' WHEN 1 THEN '2001-07' ELSE '2001-07-09' END AS born, CASE c_custkey % 3 WHEN 0 THEN '2001-01-01' WHEN 1 THEN '2001-07-01' ELSE '2001-07-09' END AS born_sort, '2020-03-01 01:30:00.5' AS seen_sort FROM customer")
def shred_lexical(spark: SparkSession, path: str) -> DataFrame:
    """Numbers and dates as written, and what they are sorted by."""
    (base,) = _rows(spark, path, "thing")
    return base.select("id", "amount", "born", F.col("born_sort").cast("string"), F.col("seen_sort").cast("string"))


@_query("shred_extensions", """SELECT c_custkey::varchar AS rid, x.* FROM customer, (VALUES ('', '1', 'e1', false), ('', '2', 'e2', false)) x(path, ord, url, modifier)
UNION ALL SELECT c_custkey::varchar, '', '1', 'm', true FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey::varchar, 'active', '1', 'why', false FROM customer WHERE c_custkey % 4 = 0""")
def shred_extensions(spark: SparkSession, path: str) -> DataFrame:
    (ext,) = _rows(spark, path, "thing_ext")
    return ext.where("ext_ord > 0").select("rid", "path", F.col("ext_ord").cast("string").alias("ord"), "url", "modifier").distinct()


@_query("shred_extension_leaves", "SELECT c_custkey::varchar AS rid, x.leaf, x.v_kind, CASE x.leaf WHEN 'valueInteger' THEN c_custkey::varchar ELSE x.v END AS v_text FROM customer, (VALUES ('valueInteger', 'n', ''), ('extension.0.url', 's', 'in'), ('extension.0.valueBoolean', 'b', 'true')) x(leaf, v_kind, v)")
def shred_extension_leaves(spark: SparkSession, path: str) -> DataFrame:
    (ext,) = _rows(spark, path, "thing_ext")
    return ext.where("path = '' and not modifier and ext_ord > 0").select("rid", "leaf", "v_kind", "v_text")


@_query("shred_element_ids", "SELECT c_custkey::varchar AS rid, 'nick' AS path, 2 AS ord, 'n2' AS v_text FROM customer UNION ALL SELECT c_custkey::varchar, 'active', NULL, 'a' FROM customer WHERE c_custkey % 4 = 0")
def shred_element_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of primitives, which stand in their underscored twins."""
    (ext,) = _rows(spark, path, "thing_ext")
    return ext.where("ext_ord = 0").select("rid", "path", F.get("ords", F.lit(0)).cast("int").alias("ord"), "v_text")


@_query("shred_array_twin", "SELECT c_custkey::varchar AS rid, x.ord, CASE x.ord WHEN 1 THEN 'a' || c_custkey ELSE 'Ç' END AS value, CASE x.ord WHEN 1 THEN 'a' || c_custkey ELSE 'c' END AS value_norm FROM customer, (VALUES (1), (3)) x(ord)")
def shred_array_twin(spark: SparkSession, path: str) -> DataFrame:
    """An array with a null that only its twin fills: positions stay."""
    (nick,) = _rows(spark, path, "thing_nick")
    return nick.select("rid", F.col("ords")[0].cast("int").alias("ord"), "value", "value_norm")


@_query("shred_spill", "SELECT c_custkey::varchar AS rid, 'box.inner.outer' AS path, x.leaf, x.v_kind, CASE x.leaf WHEN 'label' THEN 'deep' || c_custkey ELSE x.v END AS v_text FROM customer, (VALUES ('label', 's', ''), ('n.0', 'n', '1'), ('n.1', 'n', '2.0')) x(leaf, v_kind, v)")
def shred_spill(spark: SparkSession, path: str) -> DataFrame:
    """What lies in a type within itself, as leaves."""
    (deep,) = _rows(spark, path, "thing_deep")
    return deep.select("rid", "path", "leaf", "v_kind", "v_text")


@_query("shred_contained", """SELECT c_custkey::varchar AS rid, x.ord, x.resource FROM customer, (VALUES (1, '{"resourceType":"Part","n":1.50}'), (2, '{"x":1e2}')) x(ord, resource) WHERE c_custkey % 5 = 0""")
def shred_contained(spark: SparkSession, path: str) -> DataFrame:
    (inside,) = _rows(spark, path, "thing_contained")
    return inside.select("rid", F.col("ord").cast("int").alias("ord"), "resource")


@_query("shred_wide", "SELECT c_custkey::varchar AS rid, 1 AS ord, 'zero' AS f0, NULL AS f75, 'last' || c_custkey AS f150 FROM customer")
def shred_wide(spark: SparkSession, path: str) -> DataFrame:
    """An element of 151 columns has a table of its own, at position 1."""
    (wide,) = _rows(spark, path, "thing_wide")
    return wide.select("rid", F.col("ords")[0].cast("int").alias("ord"), "f0", "f75", "f150")


@_query("recursive_paths", "SELECT c_custkey::varchar AS rid, x.path, x.text FROM customer, (VALUES ('1', '1'), ('1.1', '1.1'), ('1.2', '1.2'), ('1.2.1', '1.2.1'), ('2', '2')) x(path, text)")
def recursive_paths(spark: SparkSession, path: str) -> DataFrame:
    """A group within itself: all depths in one table, told by their positions."""
    (entry,) = _rows(spark, path, "thing_entry")
    return entry.select("rid", F.array_join(F.transform("ords", lambda o: o.cast("string")), ".").alias("path"), "text")


#: What is wrong with a document, by its customer's number, and how it is said.
WRONG = {
    0: ('"born":"2024-99-99"', "born: is no date"), 1: ('"big":"1_000"', "big: is no int64"), 2: ('"seen":"garbage"', "seen: is no datetime"), 3: ('"shoe":44', "shoe: is not in the schema"), 4: ('"valueDecimal":1,"valueString":"x"', "valueString: excludes valueDecimal, of the same choice"),
    5: ('"nick":[null]', "nick: item 1 has neither value nor extension"), 6: ('"owner":[]', "owner: is not an object"), 7: ('"entry":[{"text":7}]', "entry.text: is no str"), 8: ('"extension":[{}]', "lists an extension that no url names"), 9: ('"nick":[]', "nick: is a list of nothing"),
    10: ('"active":"true"', "active: is no bool"), 11: ('"born":"2023-02-29"', "born: is no date"), 12: ('"_active":{"x":1}', "active: has an underscored twin with 'x'"),
}


@_query("validation_errors", "SELECT says AS error, count(*) AS n FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{says.replace(chr(39), chr(39) * 2)}')" for k, (_, says) in WRONG.items()) + ") w(k, says) ON c_custkey % 13 = k GROUP BY 1")
def validation_errors(spark: SparkSession, path: str) -> DataFrame:
    """Documents that don't fit, each in one way."""
    k = F.col("c_custkey") % len(WRONG)
    wrong = F.coalesce(*(F.when(k == i, text) for i, (text, _) in WRONG.items()))
    docs = Star(spark, path).raw("customer").select(F.concat(F.lit('{"resourceType":"Thing","id":"'), "c_custkey", F.lit('",'), wrong, F.lit("}")).alias("body"))
    return shred.errors(shred.tagged(docs, thing_map())).groupBy("error").agg(F.count("*").alias("n"))


@_query("roundtrip_things", "SELECT count(*) AS n_documents, 0 AS n_errors, 0 AS n_different FROM customer")
def roundtrip_things(spark: SparkSession, path: str) -> DataFrame:
    """Documents with every kind of element to rows and back, numbers as written."""
    docs = things(spark, path)
    tables, _ = shred.shred(docs, thing_map())
    back = reconstruct.reconstruct(tables, thing_map(), "Thing").select("id", shred.canonical("body").alias("again"), "error")
    both = spread(docs).select("id", shred.canonical("body").alias("body")).join(back, "id", "left")
    return both.agg(F.count("*").alias("n_documents"), F.count("error").cast("int").alias("n_errors"), F.sum((~F.col("body").eqNullSafe(F.col("again"))).cast("int")).cast("int").alias("n_different"))


@_query("damaged_rows", "SELECT error, count(*) AS n FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'entry: positions are not 1, 2, 3 and so on' WHEN 1 THEN 'two rows of a table have one place' WHEN 2 THEN 'has rows, but none in the base table' WHEN 3 THEN 'extensions are not 1, 2, 3 and so on' END AS error FROM customer) WHERE error IS NOT NULL GROUP BY 1")
def damaged_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that were lost or doubled are told, each kind for a fifth of the documents."""
    tables, _ = shred.shred(things(spark, path), thing_map())
    k = F.col("rid").cast("int") % 5
    tables["thing_entry"] = tables["thing_entry"].where(~((k == 0) & (F.size("ords") == 1) & (F.col("ords")[0] == 1)))
    tables["thing_nick"] = tables["thing_nick"].union(tables["thing_nick"].where(k == 1))
    tables["thing"] = tables["thing"].where("cast(id AS int) % 5 <> 2")
    tables["thing_ext"] = tables["thing_ext"].where(~((k == 3) & (F.col("url") == "e1")))
    found = reconstruct.reconstruct(tables, thing_map(), "Thing").where("error is not null")
    return found.groupBy(F.regexp_replace("error", "^: ", "").alias("error")).agg(F.count("*").alias("n"))


@_query("leaf_roundtrip", "SELECT count(*) AS n, 0 AS n_different FROM events")
def leaf_roundtrip(spark: SparkSession, path: str) -> DataFrame:
    """Any JSON as leaves and back."""

    @F.udf("string")
    def again(body: str) -> str:
        return leaves.to_text(leaves.flatten(leaves.loads(body)))

    rows = Star(spark, path).raw("events").select(F.regexp_replace("props", " ", "").alias("body"))
    return rows.agg(F.count("*").alias("n"), F.sum((F.col("body") != again("body")).cast("int")).cast("int").alias("n_different"))


#: Documents of a file at most, so that more documents are more files.
FILE_DOCUMENTS = 5000


@_query("read_files", "SELECT kind, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'gzipped line' WHEN 2 THEN 'bundle' ELSE 'not JSON' END AS kind FROM customer) GROUP BY 1")
def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of lines, plain and gzipped, a bundle, and broken lines, told apart by their content."""
    docs, at = things(spark, path), scratch(spark, "files")
    lines = {"line": docs.where("k % 4 = 0").select("body"), "gzip": docs.where("k % 4 = 1").select("body"), "broken": docs.where("k % 4 = 3").select(F.concat(F.lit("{broken "), "id"))}
    for name, df in lines.items():
        df.write.option("maxRecordsPerFile", FILE_DOCUMENTS).text(f"{at}/{name}", compression="gzip" if name == "gzip" else "none")
    # a file of a bundle is one text; keys are unique, so a bundle has a file's documents at most
    group = F.floor(F.col("k") / (4 * FILE_DOCUMENTS))
    entries = docs.where("k % 4 = 2").groupBy(group).agg(F.array_join(F.transform(F.collect_list("body"), lambda b: F.concat(F.lit('{"resource":'), b, F.lit("}"))), ",").alias("e"))
    entries.select(F.concat(F.lit('{"resourceType":"Bundle","entry":['), "e", F.lit("]}"))).write.option("maxRecordsPerFile", 1).text(f"{at}/bundle")
    rows = documents.read(spark, f"{at}/*/part-*").where("error is null")
    bad = F.col("body").startswith("{broken")
    kind = F.when(bad, "not JSON").when(F.contains("context", F.lit("#")), "bundle").when(F.contains("context", F.lit(".gz")), "gzipped line").otherwise("line")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


RULES = [
    ('"status":"final","unit":"a b","count":7,"at":"10:00:00"', ""), ('"unit":"x"', "status: is missing"), ('"status":" final"', "status: is no code"), ('"status":"final","unit":""', "unit: is no string"), ('"status":"final","count":0', "count: is no positiveInt"), ('"status":"final","at":"24:00:00"', "at: is no time"),
    ('"status":"final","part":[{"code":"c"},{"size":1}]', "part.code: is missing"), ('"status":"final","valueCode":"a  b"', "valueCode: is no code"),
]


@lru_cache(maxsize=1)
def rule_map() -> RelMap:
    primitives = [{"kind": "primitive-type", "name": p} for p in ("string", "code", "positiveInt", "time", "integer")]
    must = lambda path, kind: _element(path, kind) | {"min": 1}
    value = {"path": "Check.value[x]", "max": "1", "type": [{"code": "code"}, {"code": "string"}]}
    fields = [must("Check.status", "code"), _element("Check.unit", "string"), _element("Check.count", "positiveInt"), _element("Check.at", "time"), value, _element("Check.part", "", True), must("Check.part.code", "code"), _element("Check.part.size", "integer")]
    return build_map(load_spec([*primitives, {"kind": "resource", "name": "Check", "snapshot": {"element": fields}}]), "checks")


@_query("typed_validation", "SELECT says AS problem, count(*) AS n FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{says}')" for k, (_, says) in enumerate(RULES) if says) + f") w(k, says) ON c_custkey % {len(RULES)} = k GROUP BY 1")
def typed_validation(spark: SparkSession, path: str) -> DataFrame:
    """Rules of types beyond what the tables ask for: elements that must be there, forms of codes, numbers and times."""
    k = F.col("c_custkey") % len(RULES)
    docs = Star(spark, path).raw("customer").select(F.concat(F.lit('{"resourceType":"Check","id":"'), "c_custkey", F.lit('",'), F.coalesce(*(F.when(k == i, text) for i, (text, _) in enumerate(RULES))), F.lit("}")).alias("body"))
    return validate.validate(docs, rule_map()).groupBy(F.concat_ws(": ", "path", "problem").alias("problem")).agg(F.count("*").alias("n"))


# --- searches on documents' tables ---


def searcher(spark: SparkSession, path: str) -> Searcher:
    rows = checkpoint(shred.tagged(things(spark, path), thing_map()))
    tables = {t.name: shred.table_of(rows, t) for t in thing_map().resources["Thing"].tables if t.kind != "history"}
    return Searcher(thing_map(), tables.__getitem__)


@_query("thing_searches", """SELECT * FROM (SELECT 'active=true' AS search, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'worth=gt100', c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey + 0.5 > 100
UNION ALL SELECT 'said=V1', c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_custkey::varchar LIKE '1%' UNION ALL SELECT 'said:exact=v1', c_custkey FROM customer WHERE c_custkey = 1
UNION ALL SELECT 'nick=c', c_custkey FROM customer UNION ALL SELECT 'born=2001-07', c_custkey FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'owner=Nation/3', c_custkey FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'step=1.2.1', c_custkey FROM customer)""")
def thing_searches(spark: SparkSession, path: str) -> DataFrame:
    """Searches by compiled parameters over columns, children and variants of a choice."""
    s, out = searcher(spark, path), None
    for q in ("active=true", "worth=gt100", "said=V1", "said:exact=v1", "nick=c", "born=2001-07", "owner=Nation/3", "step=1.2.1"):
        found = s.matches("Thing", [tuple(q.split("="))]).select(F.lit(q).alias("search"), F.col("id").cast("int").alias("c_custkey"))
        out = found if out is None else out.union(found)
    return out


REFUSALS = {
    "shoe=1": "no search parameter", "active:not=true": "no modifier", "said:missing=true": "no modifier", "born=soon": "is no date", "worth=much": "is no number", "both=x": "looks nowhere", "lost=x": "looks nowhere", "owner.name=x": "leads to", "owner:Ship.name=x": "the map lacks", "active:Thing.born=2001": "refers to no document",
    "owner:Thing.owner:Thing.active=true": "one hop", "_elements=id": "no parameter", "_count=-1": "must be a number", "_cursor=a&_sort=born": "order by id", "born=ap2001": "prefix ap",
}


@_query("refused_searches", "SELECT * FROM (VALUES " + ", ".join(f"('{q}', true)" for q in REFUSALS) + ") t(search, refused)")
def refused_searches(spark: SparkSession, path: str) -> DataFrame:
    """Searches that can't be meant are refused, and the message says why."""
    s, out = Searcher(thing_map(), lambda name: spark.createDataFrame([], evolve.schema(next(t for t in thing_map().resources["Thing"].tables if t.name == name)))), []
    for q, says in REFUSALS.items():
        try:
            s.page("Thing", Request.parse(q)).columns
            out.append((q, False))
        except UnsupportedSearch as problem:
            out.append((q, says in str(problem)))
    return spark.createDataFrame(out, "search string, refused boolean")


@_query("request_parts", "SELECT 3 AS count, 6 AS offset_, '-born,active' AS sort, 'none' AS total, 'Thing:owner' AS include, 'active=true' AS criteria")
def request_parts(spark: SparkSession, path: str) -> DataFrame:
    r = Request.parse("active=true&_count=3&_offset=6&_sort=-born,active&_total=none&_include=Thing:owner&_format=json")
    return spark.createDataFrame([(r.count, r.offset, ",".join(r.sort), r.total, ",".join(r.include), "&".join("=".join(c) for c in r.criteria))], "count int, offset_ int, sort string, total string, include string, criteria string")


# --- generated maps ---


@_query("compiled_support", """SELECT * FROM (VALUES ('active', 'token', true, ''), ('any', 'token', true, ''), ('born', 'date', true, ''), ('both', 'composite', false, 'a composite parameter has no path of its own'), ('far', 'special', false, 'a special parameter has no path of its own'),
('lost', 'token', false, 'nowhere isn''t an element there'), ('nick', 'string', true, ''), ('owner', 'reference', true, ''), ('said', 'string', true, ''), ('step', 'string', true, ''), ('worth', 'number', true, '')) t(code, kind, compiled, note)""")
def compiled_support(spark: SparkSession, path: str) -> DataFrame:
    """What the compiler made of each parameter, and why not."""
    return spark.createDataFrame([r[1:] for r in support_matrix(thing_map())], "code string, kind string, compiled boolean, note string")


@_query("compiled_targets", "SELECT * FROM (VALUES ('active', 'thing', 'active'), ('any', 'thing', 'value_decimal'), ('any', 'thing', 'value_string'), ('born', 'thing', 'born_sort'), ('nick', 'thing_nick', 'value'), ('owner', 'thing', 'owner_ref_id'), ('said', 'thing', 'value_string'), ('step', 'thing_entry', 'text'), ('worth', 'thing', 'value_decimal_num')) t(code, table_name, column_name)")
def compiled_targets(spark: SparkSession, path: str) -> DataFrame:
    r = thing_map().resources["Thing"]
    main = {"token": "code", "date": "lo", "string": "col", "number": "col", "reference": "id"}
    return spark.createDataFrame([(p.code, r.tables[t.table].name, t.columns[main[t.kind]]) for p in r.params for t in p.targets], "code string, table_name string, column_name string")


@_query("generated_tables", "SELECT * FROM (VALUES ('thing', 'base', 21), ('thing_nick', 'elem', 4), ('thing_wide', 'elem', 153), ('thing_entry', 'elem', 4), ('thing_ext', 'ext', 11), ('thing_deep', 'deep', 8), ('thing_contained', 'contained', 3), ('thing_history', 'history', 11)) t(table_name, kind, n_columns)")
def generated_tables(spark: SparkSession, path: str) -> DataFrame:
    """The tables that the generator makes, after the map went through its file format and back."""
    again = RelMap.from_bytes(thing_map().to_bytes())
    if again.checksum() != thing_map().checksum():
        raise ValueError("the map doesn't survive its file format")
    return spark.createDataFrame([(t.name, t.kind, len(evolve.columns(t))) for t in again.resources["Thing"].tables], "table_name string, kind string, n_columns int")


@_query("snake_names", "SELECT p_type AS type, lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM (SELECT DISTINCT p_type, (SELECT string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), '' ORDER BY i) FROM (SELECT unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i)) AS t FROM part)")
def snake_names(spark: SparkSession, path: str) -> DataFrame:
    """Element names as column names."""
    kinds = [r.p_type for r in Star(spark, path).raw("part").select("p_type").distinct().limit(10_000).collect()]  # a few kinds of part
    return spark.createDataFrame([(k, naming.snake("".join(naming.ucfirst(w.lower()) for w in k.split(" ")))) for k in kinds], "type string, name string")


LONG = "questionnaire_response_item_answer_value_codeable_concept_coding_extension"


@_query("fitted_names", f"SELECT * FROM (VALUES ('{LONG}', 'ques_response_item_answer_value_codeable_concept_coding_exte', true), ('short_name', 'short_name', true)) t(full_name, name, fits)")
def fitted_names(spark: SparkSession, path: str) -> DataFrame:
    """Names cut to 63 letters, the longest segments first."""
    return spark.createDataFrame([(n, naming.fit(n), len(naming.fit(n)) <= naming.LIMIT) for n in (LONG, "short_name")], "full_name string, name string, fits boolean")


@_query("capability_search", "SELECT unnest(['active', 'any', 'born', 'nick', 'owner', 'said', 'step', 'worth']) AS name, unnest(['token', 'token', 'date', 'string', 'reference', 'string', 'string', 'number']) AS kind")
def capability_search(spark: SparkSession, path: str) -> DataFrame:
    """The search parameters that the statement of what the map can do lists."""
    (kind,) = capability(thing_map())["rest"][0]["resource"]
    return spark.createDataFrame([(p["name"], p["type"]) for p in kind["searchParam"]], "name string, kind string")


@_query("installed_tables", "SELECT unnest(['thing', 'thing_contained', 'thing_deep', 'thing_entry', 'thing_ext', 'thing_history', 'thing_nick', 'thing_wide']) AS table_name")
def installed_tables(spark: SparkSession, path: str) -> DataFrame:
    """The statements that create the tables, by the names they create."""
    made = [s.split(".", 1)[1].split(" ", 1)[0] for s in evolve.ddl(thing_map()) if s.startswith("CREATE TABLE")]
    return spark.createDataFrame([(n,) for n in made], "table_name string")
