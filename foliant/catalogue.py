"""Registered queries of the document index over the driver tables, with their SQL twins.

Docbases: ``orders`` (document: order; indexes on its own columns and, multi-valued, on its line
items), ``customer``, ``part``, ``supplier``, ``nation``, ``region``, ``events``, ``documents`` and
``conversations``.  Links between docbases are indexes of one name, such as ``custkey``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import date_key, parse_key, time_key
from .functions.text import ascii_only, basename, element, file_docid, parent, row_xml, with_extension, xml_escape
from .operators import docbase, docset, index
from .plans.catalog import IndexDef
from .plans.compiler import Base, Compiler, Postings
from .sources.documents import extract_keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEMS = {"partkey": ("l_partkey", "int64"), "suppkey": ("l_suppkey", "int64"), "quantity": ("l_quantity", "double"), "returnflag": ("l_returnflag", "string"), "linenumber": ("l_linenumber", "int32"), "discount": ("l_discount", "double")}
#: Docbase -> its id column and its single-valued indexes.
TABLES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "orders": ("o_orderkey", {"orderkey": ("o_orderkey", "int64"), "custkey": ("o_custkey", "int64"), "status": ("o_orderstatus", "string"), "price": ("o_totalprice", "double"), "priority": ("o_orderpriority", "string")}),
    "customer": ("c_custkey", {"custkey": ("c_custkey", "int64"), "nationkey": ("c_nationkey", "int32"), "balance": ("c_acctbal", "double"), "segment": ("c_mktsegment", "string")}),
    "part": ("p_partkey", {"partkey": ("p_partkey", "int64"), "brand": ("p_brand", "string"), "size": ("p_size", "int32"), "retail": ("p_retailprice", "double")}),
    "supplier": ("s_suppkey", {"suppkey": ("s_suppkey", "int64"), "nationkey": ("s_nationkey", "int32"), "balance": ("s_acctbal", "double")}),
    "nation": ("n_nationkey", {"nationkey": ("n_nationkey", "int32"), "nation": ("n_name", "string"), "regionkey": ("n_regionkey", "int32")}),
    "region": ("r_regionkey", {"regionkey": ("r_regionkey", "int32"), "region": ("r_name", "string")}),
    "events": ("event_id", {"userkey": ("user_id", "int64"), "kind": ("event_type", "string"), "value": ("value", "double")}),
}


class Bases(Mapping[str, Base]):
    """Docbases whose tables are opened when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.open = spark, sf_dir, {}

    def __getitem__(self, name: str) -> Base:
        if name not in self.open:
            docid, single = TABLES[name]
            many = {}
            if name == "orders":
                items = read(self.spark, self.sf_dir, "lineitem")
                many = {n: Postings(items, "l_orderkey", c, k) for n, (c, k) in ITEMS.items()}
            self.open[name] = Base(name, read(self.spark, self.sf_dir, name), docid, single, many)
        return self.open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def __contains__(self, name: object) -> bool:
        return name in TABLES


def bases(spark: SparkSession, sf_dir: str) -> Mapping[str, Base]:
    return Bases(spark, sf_dir)


def ask(name: str, text: str, sql: str, base: str = "orders", dialect: str = "all") -> None:
    """Register a query text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Compiler(bases(spark, sf_dir), dialect).query(text, base)

    run.__name__ = name
    query(sql)(run)


def _docs(where: str) -> str:
    return f"SELECT o_orderkey AS docid FROM orders WHERE {where}"


def _items(where: str) -> str:
    return f"(SELECT l_orderkey FROM lineitem WHERE {where})"


for _name, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    ask(f"term_{_name}", f"custkey {_op} 75", _docs(f"o_custkey {_op.replace('!=', '<>')} 75"))
    ask(f"term_double_{_name}", f"price {_op} 250000.5", _docs(f"o_totalprice {_op.replace('!=', '<>')} 250000.5"))
ask("term_string_eq", 'priority = "1-URGENT"', _docs("o_orderpriority = '1-URGENT'"))
ask("term_string_gte", "status >= O", _docs("o_orderstatus >= 'O'"))
ask("mv_eq", "quantity = 10", _docs(f"o_orderkey IN {_items('l_quantity = 10')}"))
ask("mv_ne", "quantity != 10", _docs(f"o_orderkey NOT IN {_items('l_quantity = 10')}"))
ask("mv_gt", "quantity > 40", _docs(f"o_orderkey IN {_items('l_quantity > 40')}"))
ask("mv_gte", "quantity >= 40", _docs(f"o_orderkey IN {_items('l_quantity >= 40')}"))
ask("mv_lte_all", "quantity <= 10", _docs(f"o_orderkey NOT IN {_items('l_quantity > 10')}"))
ask("mv_lt_all", "quantity < 10", _docs(f"o_orderkey NOT IN {_items('l_quantity >= 10')}"))
ask("mv_lte_any", "quantity <= 10", _docs(f"o_orderkey IN {_items('l_quantity <= 10')}"), dialect="any")
ask("mv_lt_any", "quantity < 10", _docs(f"o_orderkey IN {_items('l_quantity < 10')}"), dialect="any")
ask("absent_key_ne", "quantity != 10.5", _docs(f"o_orderkey NOT IN {_items('l_quantity = 10.5')}"))
ask("absent_key_gt", "quantity > 10.5", _docs(f"o_orderkey IN {_items('l_quantity > 10.5')}"))
ask("absent_key_lte", "quantity <= 0.5", _docs(f"o_orderkey NOT IN {_items('l_quantity > 0.5')}"))
ask("bool_and", "status = F & price > 250000", _docs("o_orderstatus = 'F' AND o_totalprice > 250000"))
ask("bool_or", 'status = F | priority = "1-URGENT"', _docs("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"))
ask("bool_xor", "status = F ^ price > 250000", _docs("(o_orderstatus = 'F') <> (o_totalprice > 250000)"))
ask("bool_not", "!(status = F | price > 250000)", _docs("NOT (o_orderstatus = 'F' OR o_totalprice > 250000)"))
ask("bool_not_mv", "!(quantity = 10 & quantity > 40)", _docs(f"NOT (o_orderkey IN {_items('l_quantity = 10')} AND o_orderkey IN {_items('l_quantity > 40')})"))
ask("bool_xor_mv", "quantity = 10 ^ quantity > 40", f"SELECT docid FROM ((SELECT l_orderkey AS docid FROM lineitem WHERE l_quantity = 10 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) UNION (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity = 10))")
ask("bool_right_assoc", 'status = F & price > 250000 | priority = "1-URGENT"', _docs("o_orderstatus = 'F' AND (o_totalprice > 250000 OR o_orderpriority = '1-URGENT')"))
ask("bool_grouped", '(status = F & price > 250000) | priority = "1-URGENT"', _docs("(o_orderstatus = 'F' AND o_totalprice > 250000) OR o_orderpriority = '1-URGENT'"))
ask("rule_b_three_terms", "(quantity > 40 & quantity != 10) | quantity < 5", _docs(f"(o_orderkey IN {_items('l_quantity > 40')} AND o_orderkey NOT IN {_items('l_quantity = 10')}) OR o_orderkey NOT IN {_items('l_quantity >= 5')}"))
ask("mixed_single_and_mv", "status = F & (returnflag = R | quantity >= 45) & price < 300000", _docs(f"o_orderstatus = 'F' AND (o_orderkey IN {_items(chr(108) + '_returnflag = ' + chr(39) + 'R' + chr(39))} OR o_orderkey IN {_items('l_quantity >= 45')}) AND o_totalprice < 300000"))
ask("deep_tree", '!(((status = F ^ quantity > 45) & !(price <= 100000)) | (returnflag = N & (priority != "5-LOW" | linenumber > 6)))', _docs(f"NOT ((((o_orderstatus = 'F') <> (o_orderkey IN {_items('l_quantity > 45')})) AND NOT (o_totalprice <= 100000)) OR (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AND (o_orderpriority <> '5-LOW' OR o_orderkey IN {_items('l_linenumber > 6')})))"))
ask("events_and", "kind = click & value > 50", "SELECT event_id AS docid FROM events WHERE event_type = 'click' AND value > 50", base="events")
ask("xref_semi", "orders.status = F & orders.price > 400000", "SELECT c_custkey AS docid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)", base="customer")
ask("xref_and", "segment = BUILDING & orders.price > 400000", "SELECT c_custkey AS docid FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", base="customer")
ask("xref_not", "!(orders.price > 100000)", "SELECT c_custkey AS docid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", base="customer")
RICH = "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"
for _name, _sign, _op in (("and", "&", "AND"), ("or", "|", "OR"), ("xor", "^", "<>")):
    ask(f"xref_not_{_name}", f"!(segment = BUILDING {_sign} orders.price > 400000)", f"SELECT c_custkey AS docid FROM customer WHERE NOT ((c_mktsegment = 'BUILDING') {_op} ({RICH}))", base="customer")
ask("xref_and_not", "segment = BUILDING & !(orders.price > 400000) & balance > 0", f"SELECT c_custkey AS docid FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT ({RICH}) AND c_acctbal > 0", base="customer")
ask("xref_ne", "orders.price != 100000", "SELECT c_custkey AS docid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice <> 100000)", base="customer")
ask("xref_xor", "balance > 0 ^ orders.price > 400000", "SELECT c_custkey AS docid FROM customer WHERE (c_acctbal > 0) <> (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))", base="customer")
ask("xref_mv", "part.size > 45 & status = F", "SELECT o_orderkey AS docid FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45)")


@query("SELECT p_partkey AS docid FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)))")
def xref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> orders -> part."""
    c = Compiler(bases(spark, sf_dir))
    return c.convert(c.convert(c.query("balance > 9000", "customer"), "customer", "orders"), "orders", "part", "partkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS docid FROM orders WHERE CAST(o_custkey AS VARCHAR) < '9'")
def string_lex_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of type string compare as bytes."""
    orders = read(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    return Compiler({"o": Base("o", orders, "o_orderkey", {"k": ("k", "string")})}, "any").query('k < "9"', "o")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("key"), F.col("l_orderkey").alias("docid"))


@query("SELECT DISTINCT l_quantity AS key, l_orderkey AS docid FROM lineitem")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(quantities(spark, sf_dir))


@query("SELECT o_orderpriority AS key, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS docids FROM orders GROUP BY 1")
def index_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.show(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("docid")))


@query("SELECT l_quantity AS key, count(l_orderkey) AS occurrences, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1")
def index_list_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lists(quantities(spark, sf_dir))


@query("SELECT k.key, count(DISTINCT l_orderkey) AS documents FROM (VALUES (1.0::DOUBLE), (10.0), (10.5), (50.0), (99.0)) k(key) LEFT JOIN lineitem ON l_quantity = k.key GROUP BY 1")
def index_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1.0,), (10.0,), (10.5,), (50.0,), (99.0,)], "key double")
    return index.get(quantities(spark, sf_dir), asked)


@query("SELECT DISTINCT l_orderkey AS docid FROM lineitem WHERE l_quantity BETWEEN 10.5 AND 12")
def key_range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.key_range(quantities(spark, sf_dir), 10.5, 12.0)


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS documents FROM lineitem WHERE l_quantity BETWEEN 10.5 AND 12")
def bitmap_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same union on bitmaps, counted without listing it."""
    maps = index.bitmaps(quantities(spark, sf_dir).where(F.col("key").between(10.5, 12.0)).withColumn("docid", F.col("docid") + 1))
    return index.bitmap_union_count(maps)


@query("SELECT min(l_quantity) AS key FROM lineitem WHERE l_quantity >= 10.5")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lower_bound(quantities(spark, sf_dir), 10.5)


@query("SELECT DISTINCT l_quantity AS key FROM lineitem WHERE l_quantity >= 40")
def key_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cursor(quantities(spark, sf_dir), 40.0)


@query("SELECT count(DISTINCT l_quantity) AS keys, count(DISTINCT l_orderkey) AS documents, count(*) AS postings FROM (SELECT DISTINCT l_quantity, l_orderkey FROM lineitem)")
def key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.summary(index.build(quantities(spark, sf_dir)))


@query("SELECT count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_quantity > 40")
def hit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.cardinality(Compiler(bases(spark, sf_dir)).query("quantity > 40", "orders"))


@query("SELECT l_quantity AS key, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.duplicates(quantities(spark, sf_dir))


@query("SELECT doc_id AS docid, text AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def docs_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse index (labels) over documents; contents are read for hits alone."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    base = Base("documents", docs, "doc_id", {"lang": ("lang", "string")}, {"quality": Postings(labels, "doc_id", "quality", "int32")})
    found = Compiler({"documents": base}).query("quality = 1", "documents")
    return docs.select(F.col("doc_id").alias("docid"), F.col("text").alias("content")).join(found, "docid", "left_semi")


@query("SELECT o_orderkey AS docid, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 20")
def top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report: the first 20 documents of a result."""
    found = Compiler(bases(spark, sf_dir)).query("status = F", "orders")
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid"), F.col("o_totalprice").alias("price"))
    return docs.join(found, "docid", "left_semi").orderBy("docid").limit(20)


@query("SELECT DISTINCT conv_id AS docid FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def conversations_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    base = Base("c", turns.select("conv_id").distinct(), "conv_id", {}, {"role": Postings(turns, "conv_id", "role", "string")})
    return Compiler({"c": base}).query("role != system", "c")


def flagged(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Compiler(bases(spark, sf_dir)).query(text, "orders").select((F.col("docid") + 1).alias("docid"))


@query("SELECT g AS docid FROM generate_series(1, (SELECT max(o_orderkey) + 5001 FROM orders)) t(g) EXCEPT SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F'")
def docset_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complement over the capacity: room for 5,000 more than the table has."""
    capacity = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] + 5001
    return docset.flip(flagged(spark, sf_dir, "status = F"), capacity)


@query("SELECT docid FROM ((SELECT o_orderkey + 1 AS docid FROM orders WHERE o_orderstatus = 'F') UNION (SELECT o_orderkey + 1 FROM orders WHERE o_totalprice > 250000))")
def docset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.union(flagged(spark, sf_dir, "status = F"), flagged(spark, sf_dir, "price > 250000"))


@query("SELECT o_orderkey + 1 AS docid FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey + 1 FROM orders WHERE o_totalprice > 250000")
def docset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.intersect(flagged(spark, sf_dir, "status = F"), flagged(spark, sf_dir, "price > 250000"))


@query("SELECT o_orderkey + 1 AS docid FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 250000)")
def docset_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.xor(flagged(spark, sf_dir, "status = F"), flagged(spark, sf_dir, "price > 250000"))


@query("SELECT k AS docid, k IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F') AS member FROM (VALUES (1::BIGINT), (2), (3), (999999)) t(k)")
def docset_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.contains(flagged(spark, sf_dir, "status = F"), spark.createDataFrame([(1,), (2,), (3,), (999999,)], "docid long"))


@query("SELECT o_orderkey + 1 AS docid FROM orders WHERE o_orderstatus = 'F' AND o_orderkey + 1 <> 3 UNION SELECT 100001")
def docset_insert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.insert(docset.insert(docset.remove(flagged(spark, sf_dir, "status = F"), 3), 100_001), 100_001)


def some_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docbase with gaps in its ids: finished orders."""
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("docid"), F.concat(F.lit("order-"), F.col("o_orderkey"), F.lit(".xml")).alias("name"), F.col("o_orderpriority").alias("content"))


SOME = "SELECT o_orderkey + 1 AS docid, 'order-' || o_orderkey || '.xml' AS name, o_orderpriority AS content FROM orders WHERE o_orderstatus = 'F'"
CAPACITY = 400_000
NEW = "SELECT 'new-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.xml' AS name, n_name AS content FROM nation"
ALLOCATED = f"""SELECT name, content, docid FROM (SELECT *, row_number() OVER (ORDER BY name) AS rn FROM ({NEW})) JOIN
    (SELECT g AS docid, row_number() OVER (ORDER BY g) AS rn FROM generate_series(1, {CAPACITY}) t(g) WHERE g NOT IN (SELECT docid FROM ({SOME}))) USING (rn)"""


def new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("new-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".xml")).alias("name"), F.col("n_name").alias("content"))


@query(f"SELECT min(g) AS docid FROM generate_series(1, {CAPACITY}) t(g) WHERE g NOT IN (SELECT docid FROM ({SOME}))")
def free_docid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docbase.lowest_free(some_docs(spark, sf_dir), CAPACITY)


@query(f"SELECT name, docid FROM ({ALLOCATED})")
def alloc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docbase.allocate(some_docs(spark, sf_dir), new_docs(spark, sf_dir), CAPACITY)


@query(f"SELECT docid, name, CASE WHEN docid % 3 = 0 THEN 'changed' ELSE content END AS content FROM ({SOME}) UNION ALL SELECT docid, name, content FROM ({ALLOCATED})")
def upsert_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names keep their ids, new ones take the lowest free."""
    docs = some_docs(spark, sf_dir)
    batch = docs.where("docid % 3 = 0").select("name", F.lit("changed").alias("content")).union(new_docs(spark, sf_dir))
    return docbase.upsert(docs, batch, CAPACITY)


@query(f"SELECT * FROM ({SOME}) WHERE content <> '5-LOW'")
def del_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = some_docs(spark, sf_dir)
    return docbase.delete(docs, docs.where("content = '5-LOW'").select("name").union(spark.createDataFrame([("unknown.xml",)], "name string")))


@query("SELECT DISTINCT l_quantity AS key, l_orderkey AS docid FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def del_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings of deleted documents go; keys that become empty vanish."""
    gone = Compiler(bases(spark, sf_dir)).query("status = F", "orders")
    return index.delete(index.build(quantities(spark, sf_dir)), gone)


@query("SELECT DISTINCT l_quantity AS key, l_orderkey AS docid FROM lineitem UNION SELECT 99.0, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def put_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = Compiler(bases(spark, sf_dir)).query("status = F", "orders").select(F.lit(99.0).alias("key"), "docid")
    return index.put(index.put(index.build(quantities(spark, sf_dir)), more), more)


@query("SELECT DISTINCT l_quantity AS key, l_orderkey AS docid FROM lineitem EXCEPT SELECT 10.0, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def unput(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = Compiler(bases(spark, sf_dir)).query("status = F", "orders").select(F.lit(10.0).alias("key"), "docid")
    return index.unput(index.build(quantities(spark, sf_dir)), gone)


@query("SELECT DISTINCT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN l_discount ELSE l_quantity END AS key, l_orderkey AS docid FROM lineitem")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of some documents replaced by freshly extracted ones."""
    touched = Compiler(bases(spark, sf_dir)).query("status = F", "orders")
    fresh = index.restrict(read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("key"), F.col("l_orderkey").alias("docid")), touched)
    return docbase.reindex(index.build(quantities(spark, sf_dir)), fresh, touched)


@query("SELECT event_id AS docid, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS key FROM events")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("docid"), date_key(F.col("ts")).alias("key"))


@query("SELECT event_id AS docid, CAST(floor(epoch(ts)) AS BIGINT) AS key FROM events")
def time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("docid"), time_key(F.col("ts"), clock=True).alias("key"))


@query("SELECT p_partkey AS docid, left(p_name, 8) AS key FROM part")
def char8_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("docid"), parse_key(F.col("p_name"), "char8").alias("key"))


@query("SELECT l_orderkey AS docid, l_linenumber AS n, CAST(CASE WHEN l_partkey % 256 >= 128 THEN l_partkey % 256 - 256 ELSE l_partkey % 256 END AS INTEGER) AS signed, CAST((4294967296 - l_suppkey) % 4294967296 AS BIGINT) AS wrapped FROM lineitem")
def integer_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of numbers beyond a type's width wraps."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("docid"), F.col("l_linenumber").alias("n"), parse_key(F.col("l_partkey").cast("string"), "int8").cast("int").alias("signed"), parse_key(F.concat(F.lit("-"), F.col("l_suppkey")), "uint32").alias("wrapped"))


@query("SELECT o_orderkey AS docid, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS whole, CAST(o_totalprice AS DOUBLE) AS real, CAST(0 AS INTEGER) AS nothing FROM orders")
def prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest numeric prefix counts; none is zero."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid"), parse_key(F.col("o_orderpriority"), "int32").alias("whole"), parse_key(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("x")), "double").alias("real"), parse_key(F.col("o_orderstatus"), "int32").alias("nothing"))


@query("SELECT doc_id AS docid, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS content FROM documents")
def xml_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), xml_escape(F.col("text")).alias("content"))


@query("SELECT doc_id AS docid, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS content FROM documents")
def ascii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), ascii_only(F.col("text")).alias("content"))


@query("SELECT o_orderkey AS docid, '<order><o_orderkey>' || o_orderkey || '</o_orderkey><o_orderpriority>' || o_orderpriority || '</o_orderpriority></order>' AS content FROM orders")
def row_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid"), row_xml("order", ["o_orderkey", "o_orderpriority"]).alias("content"))


@query("SELECT DISTINCT l_orderkey AS docid, l_quantity AS key FROM lineitem")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as XML documents with a repeated element; its texts become typed keys again."""
    items = read(spark, sf_dir, "lineitem")
    parts = element("quantity", F.col("l_quantity").cast("string"))
    docs = items.groupBy(F.col("l_orderkey").alias("docid")).agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(parts), ""), F.lit("</order>")).alias("content"))
    return extract_keys(docs, IndexDef("quantity", "double", "/order/quantity"))


@query("SELECT page_id AS docid, regexp_extract(url, '[^/]*$') AS name, regexp_replace(url, '/[^/]*$', '') AS folder, regexp_replace(url, '\\.[^./]*$', '') || '.index' AS file, CAST(coalesce(nullif(regexp_extract(regexp_extract(url, '[^/]*$'), '^[0-9]+'), ''), '0') AS BIGINT) AS number FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("docid"), basename(url).alias("name"), parent(url).alias("folder"), with_extension(url, "index").alias("file"), file_docid(url).alias("number"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished expensive orders with a large or returned item."""
    return Compiler(bases(spark, sf_dir)).query("status = F & price > 100000 & (quantity > 45 | returnflag = R)", "orders")

