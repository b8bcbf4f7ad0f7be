"""Registered queries that go through files, stores, the engine and the shell, with SQL twins.

What they write lies in new folders below the shared one.  Tables that become many small files,
or statements of the command language, are the fixed ones of 5 and 25 rows.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shell
from .catalogue import ORACLE_SQL, QUERIES, SOME, bases, flagged, quantities, query, read, some_docs
from .engine import Engine
from .functions.keys import key_text, key_type
from .functions.text import element, or_missing, xml_escape
from .operators import docbase, docset, index
from .operators.results import Results
from .operators.store import Store
from .plans.catalog import Catalog, DocBaseDef, IndexDef, load_catalog
from .plans.compiler import Compiler
from .plans.parser import ParseError, parse
from .plans.tree import Pair, check, count_terms, max_documents
from .sources import documents as sources
from .storage import folder, write_text


def texts(*columns: Column) -> Column:
    return F.concat(*[c.cast("string") for c in columns])


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, content``: 25 documents."""
    n = read(spark, sf_dir, "nation")
    body = F.concat(element("name", xml_escape(F.col("n_name"))), element("key", F.col("n_nationkey").cast("string")), element("region", F.col("n_regionkey").cast("string")), F.when(F.col("n_nationkey") % 2 == 0, "<even/>").otherwise(""))
    return n.select(texts(F.col("n_nationkey"), F.lit(".xml")).alias("name"), element("nation", body).alias("content"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return r.select(texts(F.col("r_regionkey"), F.lit(".xml")).alias("name"), element("region", F.concat(element("region", F.col("r_regionkey").cast("string")), element("rname", F.col("r_name")))).alias("content"))


CONTENT = "'<nation><name>' || n_name || '</name><key>' || n_nationkey || '</key><region>' || n_regionkey || '</region>' || CASE WHEN n_nationkey % 2 = 0 THEN '<even/>' ELSE '' END || '</nation>'"


def nation_files(spark: SparkSession, sf_dir: str, by_region: bool = False) -> str:
    """A folder with a file for each of the 25 nations, by region on demand."""
    root = folder(spark, "nations")
    for row in nations(spark, sf_dir).withColumn("r", F.regexp_extract("content", "<region>([0-9]+)", 1)).collect():
        write_text(spark, f"{root}/{row['r'] + '/' if by_region else ''}{row['name']}", row["content"])
    return root


# configuration and names


def config(spark: SparkSession, sf_dir: str) -> Catalog:
    """A docbase for each region with an index for each nation; odd ones have no key."""
    key = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<key>/n/k"), "n_nationkey", F.lit("</key>"))).otherwise("")
    own = F.concat(F.lit('<index name="'), "n_name", F.lit('" type="Int32" unique="'), F.when(F.col("n_nationkey") % 4 == 0, "true").otherwise("false"), F.lit('">'), key, F.lit("</index>"))
    both = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    docs = both.groupBy("r_regionkey", "r_name").agg(F.array_join(F.collect_list(own), "").alias("i"))
    docs = docs.select(F.concat(F.lit('<documents name="'), "r_name", F.lit('" format="xml" dir="/d/'), "r_regionkey", F.lit('" capacity="'), F.col("r_regionkey") + 1000, F.lit('"><indexes directory="/i/'), "r_regionkey", F.lit('">'), "i", F.lit("</indexes></documents>")))
    path = folder(spark, "config") + "/c.xml"
    write_text(spark, path, "<c>" + "".join(r[0] for r in docs.collect()) + "</c>")  # five rows
    return load_catalog("".join(r["content"] for r in sources.read_documents(spark, path).collect()))


@query("SELECT r_name AS base, '/d/' || r_regionkey AS folder, '/i/' || r_regionkey AS data, CAST(r_regionkey + 1000 AS BIGINT) AS capacity, n_name AS name, 'Int32' AS type, '/n/k' || n_nationkey AS path, n_nationkey % 4 = 0 AS uniq FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def config_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b.name, b.directory, b.data, b.capacity, i.name, i.type, i.path, i.unique) for b in config(spark, sf_dir).bases.values() for i in b.indexes.values()]
    return spark.createDataFrame(rows, "base string, folder string, data string, capacity long, name string, type string, path string, uniq boolean")


@query("SELECT r_name AS asked, r_name AS base, n_name AS name, 'int32' AS type FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docbases by folder, indexes by name, types in any case."""
    c, rows = config(spark, sf_dir), []
    for b in c.bases.values():
        for name in b.indexes:
            rows.append((b.name, c.by_directory(b.directory + "/").name, c.by_name(b.name).index(name).name, key_type(b.index(name).type).name))
    return spark.createDataFrame(rows, "asked string, base string, name string, type string")


@query("SELECT r_name AS base, count(*) AS files, '/d/' || r_regionkey || '/' || min(n_name) || '.xml' AS first FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the docbases of their folders."""
    files = [r[0] for r in read(spark, sf_dir, "nation").select(F.concat(F.lit("/d/"), "n_regionkey", F.lit("/"), "n_name", F.lit(".xml"))).collect()]
    return spark.createDataFrame([(b, len(f), min(f)) for b, f in config(spark, sf_dir).route(files).items()], "base string, files long, first string")


@query("SELECT * FROM (VALUES ('custkey', 'customer,orders'), ('nationkey', 'customer,nation,supplier'), ('partkey', 'orders,part'), ('regionkey', 'nation,region'), ('suppkey', 'orders,supplier'), ('balance', 'customer,supplier')) t(index, bases)")
def xref_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index names that lead from one docbase to another."""
    c = Catalog()
    for name, b in bases(spark, sf_dir).items():
        kinds = {n: k for n, (_, k) in b.single.items()} | {n: p.type for n, p in b.many.items()}
        c.bases[name] = DocBaseDef(name, f"/{name}", indexes={n: IndexDef(n, k, f"/{n}") for n, k in kinds.items()})
    return spark.createDataFrame([(n, ",".join(sorted(b))) for n, b in c.links().items()], "index string, bases string")


@query("SELECT DISTINCT o_orderkey AS docid, l_partkey AS key FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT 999999999, NULL")
def xref_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that finished orders refer to; an unknown order refers to none."""
    asked = Compiler(bases(spark, sf_dir)).query("status = F", "orders").union(spark.range(999_999_999, 1_000_000_000).toDF("docid"))
    return bases(spark, sf_dir)["orders"].cell("partkey", asked)


# query trees

ASKED = (
    ("a=1", "a=1", 1, 9),
    ("a!=1&b>=2", "(a!=1)&(b>=2)", 2, 9),
    ("a<5 & b<=2 | c>3", "(a<5)&((b<=2)|(c>3))", 3, 9),
    ("(a=1 & b=2) ^ !(x.c=3)", "((a=1)&(b=2))^(!(x.c=3))", 3, 40),
    ('n="two words"', 'n="two words"', 1, 9),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{s}', {n}::BIGINT, {m}::BIGINT)" for q, s, n, m in ASKED) + ") t(query, tree, terms, documents)")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = [(q, parse(q)) for q, *_ in ASKED]
    return spark.createDataFrame([(q, str(t), count_terms(t), max_documents(t, {"b": 9, "x": 40}, "b")) for q, t in trees], "query string, tree string, terms long, documents long")


@query("SELECT * FROM (VALUES ('a=', false), ('=1', false), ('a=1 &', false), ('((a=1))', true), ('a=1 b=2', false), ('a=1 & (b=2 | c=3)', true), ('?', false)) t(query, parsed)")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no query raises; so does a pair without an operator."""

    def ok(text: str) -> bool:
        try:
            check(Pair(parse("a=1"), parse("b=2")) if text == "?" else parse(text))
        except (ParseError, ValueError):
            return False
        return True

    return spark.createDataFrame([(q, ok(q)) for q in ("a=", "=1", "a=1 &", "((a=1))", "a=1 b=2", "a=1 & (b=2 | c=3)", "?")], "query string, parsed boolean")


@query("SELECT o_orderkey + 1 AS docid FROM orders WHERE o_orderstatus = 'F'")
def docset_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docset.ordered(flagged(spark, sf_dir, "status = F").union(flagged(spark, sf_dir, "status = F & price > 250000")))


@query("SELECT 'F' AS status, count(*) AS documents, count(*) = 0 AS is_nil, 400000::BIGINT AS size, 50000::BIGINT AS bytes FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'Z', 0, true, 400000, 50000")
def docset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, none = (docset.describe(flagged(spark, sf_dir, f"status = {x}"), 400_000).withColumn("status", F.lit(x)) for x in "FZ")
    return some.unionByName(none)


# stores


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_orderkey").alias("docid"))


def stored_index(spark: SparkSession, sf_dir: str, name: str, entries: DataFrame) -> Store:
    store = Store(spark, folder(spark, "store"))
    store.commit(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid")), {name: index.build(entries)}, expected=0)
    return store


@query("SELECT DISTINCT l_quantity AS key, l_orderkey AS docid FROM lineitem WHERE l_quantity >= 40")
def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is saved, opened with its type, and read by a range of its keys."""
    return stored_index(spark, sf_dir, "quantity", quantities(spark, sf_dir)).index("quantity").where("key >= 40")


@query("SELECT DISTINCT l_orderkey AS docid FROM lineitem WHERE l_returnflag = 'R'")
def store_string_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(stored_index(spark, sf_dir, "flag", flags(spark, sf_dir)).index("flag"), "R")


@query("SELECT DISTINCT l_returnflag AS key, l_orderkey AS docid FROM lineitem UNION SELECT 'late', o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def store_string_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version has what was put; the first stays as it was."""
    store = stored_index(spark, sf_dir, "flag", flags(spark, sf_dir))
    more = Compiler(bases(spark, sf_dir)).query("status = O", "orders").select(F.lit("late").alias("key"), "docid")
    store.commit(store.docs(1), {"flag": index.put(store.index("flag", 1), more)}, expected=1)
    return store.index("flag")


@query("SELECT DISTINCT l_orderkey AS docid FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def store_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups in one index that stays in memory."""
    store = stored_index(spark, sf_dir, "flag", flags(spark, sf_dir))
    return docset.union(index.lookup(store.cached("flag"), "R"), index.lookup(store.cached("flag"), "A"))


@query(f"SELECT 1::BIGINT AS version, * FROM ({SOME}) UNION ALL SELECT 2, * FROM ({SOME}) WHERE content <> '5-LOW'")
def store_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docbase before and after documents are deleted."""
    store, docs = Store(spark, folder(spark, "store")), some_docs(spark, sf_dir)
    store.commit(docs, {}, expected=0)
    store.commit(docbase.delete(store.docs(), docs.where("content = '5-LOW'").select("name")), {}, expected=1)
    return store.docs(1).withColumn("version", F.lit(1).cast("long")).unionByName(store.docs().withColumn("version", F.lit(2).cast("long")))


# sources and sinks


@query(f"SELECT n_nationkey || '.xml' AS name, {CONTENT} AS content FROM nation WHERE n_nationkey BETWEEN 10 AND 19")
def glob_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_documents(spark, nation_files(spark, sf_dir), glob="1?.xml").select("name", "content")


@query("SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS docid FROM nation")
def entries_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders below folders -> entries -> an entries file -> postings."""
    docs = sources.read_documents(spark, nation_files(spark, sf_dir, by_region=True), recursive=True)
    path = folder(spark, "entries")
    sources.write_entries(sources.entries_of(docs, "/nation/name"), path)
    return sources.read_entries(spark, path)


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'NOTFOUND' ELSE c_mktsegment END AS key, c_custkey AS docid FROM customer UNION ALL SELECT c_mktsegment, c_custkey FROM customer WHERE c_custkey % 3 = 1")
def entries_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing key reads NOTFOUND; duplicates stay."""
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("key"), F.concat(F.lit("/x/"), "c_custkey", F.lit(".xml")).alias("file"), "c_custkey")
    path = folder(spark, "entries")
    sources.write_entries(c.union(c.where("c_custkey % 3 = 1")).drop("c_custkey"), path)
    return sources.read_entries(spark, path)


@query("SELECT c_custkey AS docid, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'NOTFOUND' END AS name FROM customer")
def missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docid"), or_missing(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("name"))


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    parts = F.concat(F.lit('<item flag="'), "l_returnflag", F.lit('">a<q>'), F.col("l_quantity").cast("string"), F.lit("</q></item>"))
    return items.groupBy(F.col("l_orderkey").alias("docid")).agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(parts), ""), F.lit("</order>")).alias("content"))


@query("SELECT l_orderkey AS docid, l_quantity AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by a path with a predicate, duplicates included."""
    found = orders_xml(spark, sf_dir).select("docid", F.explode(sources.texts_at(F.col("content"), "/order/item[@flag='R']/q")).alias("t"))
    return found.groupBy("docid", F.col("t").cast("double").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS docid, 'a' || left(CAST(l_quantity AS VARCHAR), 7) AS key FROM lineitem")
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an element is that of everything in it."""
    return sources.extract_keys(orders_xml(spark, sf_dir), IndexDef("i", "char8", "//item"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS n, '<supplier id=\"' || s_suppkey || '\"><name>' || s_name || '</name></supplier>' AS content FROM supplier")
def records_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One large file of records, in order, becomes numbered documents."""
    s = read(spark, sf_dir, "supplier").coalesce(1).sortWithinPartitions("s_suppkey")
    body = F.concat(F.lit('<supplier id="'), "s_suppkey", F.lit('">'), element("name", xml_escape(F.col("s_name"))), F.lit("</supplier>"))
    path = folder(spark, "records")
    s.select(F.concat(F.lit("<set> "), body, F.lit("</set>")).alias("value")).write.text(path)
    return sources.read_records(spark, path, "supplier")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) || '.xml' AS name, s_name AS content FROM supplier")
def lines_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "lines")
    read(spark, sf_dir, "supplier").coalesce(1).sortWithinPartitions("s_suppkey").select("s_name").write.text(path)
    return sources.read_lines(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, '\"' || c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, '<c><id>' || c_custkey || '</id><segment>\"' || c_mktsegment || '</segment><name>' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || '</name></c>' AS xml FROM customer")
def tsv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows are padded, further fields dropped, quotes are letters, the rest of Latin-1 goes."""
    c = read(spark, sf_dir, "customer")
    row = F.concat(F.col("c_custkey").cast("string"), F.lit('\té"'), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("\t"), "c_name", F.when(F.col("c_custkey") % 3 == 1, "\tmore").otherwise(""))))
    path = folder(spark, "tsv")
    head = spark.createDataFrame([(0, "id segment name".replace(" ", "\t"))], "at int, value string")
    head.union(c.select(F.lit(1), row)).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    rows = sources.read_tsv(spark, path, ascii=True)
    return rows.withColumn("xml", F.concat(element("id", F.col("id")), element("segment", xml_escape(F.col("segment"))), element("name", xml_escape(F.col("name"))))).withColumn("xml", element("c", F.col("xml")))


@query("SELECT l_partkey AS key, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) || ',' AS docids FROM lineitem GROUP BY 1")
def index_dump_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with duplicates, as the list form prints them."""
    return index.dump_lists(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("docid")))


@query("SELECT o_orderpriority AS key, CAST(o_orderkey // 4096 AS BIGINT) AS chunk, string_agg(CAST(o_orderkey + 1 AS VARCHAR), ' ' ORDER BY o_orderkey) AS docids FROM orders GROUP BY 1, 2")
def index_show_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump whose rows stay bounded."""
    return index.show_chunks(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") + 1).alias("docid")), 4096)


@query("SELECT o_orderkey AS docid, printf('%g', sqrt(o_totalprice)) AS key, printf('%g', sqrt(o_totalprice) / 1e8) AS small, printf('%g', sqrt(o_totalprice) * 1e6) AS large, CAST(o_custkey AS VARCHAR) AS whole FROM orders")
def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.sqrt("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid"), key_text(root, "double").alias("key"), key_text(root / 1e8, "float").alias("small"), key_text(root * 1e6, "double").alias("large"), key_text(F.col("o_custkey"), "int64").alias("whole"))


# results


def results(spark: SparkSession, sf_dir: str) -> Results:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("content"))
    return Results(docs.where("docid % 10 = 3").select("docid"), docs)


@query("SELECT doc_id AS at, text AS line FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT -4611686018427387904, '<results count=\"' || count(*) || '\">' FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 4611686018427387904, '</results>'")
def result_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that a result took is left out here, as it is never the same."""
    return results(spark, sf_dir).xml_rows().select("at", F.regexp_replace("line", '^(<results count="[0-9]*") querytime="[^"]*"', "$1").alias("line"))


@query("SELECT 2 * row_number() OVER (ORDER BY doc_id) - 2 AS n, text AS line FROM (SELECT * FROM documents WHERE doc_id % 10 = 3 ORDER BY doc_id LIMIT 20) UNION ALL SELECT 2 * g - 1, '' FROM generate_series(1, (SELECT least(20, count(*)) FROM documents WHERE doc_id % 10 = 3)) t(g) UNION ALL SELECT 2 * least(20, count(*)), count(*) || ' hit(s)' FROM documents WHERE doc_id % 10 = 3")
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report: 20 documents, then how many there are."""
    return spark.createDataFrame(list(enumerate(results(spark, sf_dir).text())), "n long, line string")


# engine and shell

WORLD = """<c><documents name="nations" dir="{d}/nations" capacity="30"><indexes>
 <index name="name" type="string"><key>/nation/name</key></index><index name="key" type="int32"><key>/nation/key</key></index>
 <index name="region" type="int8"><key>/nation/region</key></index><index name="even" type="string"><key>/nation/even</key></index></indexes></documents>
 <documents name="regions" dir="{d}/regions"><indexes><index name="region" type="int8"><key>/region/region</key></index>
 <index name="rname" type="string"><key>/region/rname</key></index></indexes></documents></c>"""
#: Ids are given in the order of names.
IDS = "SELECT row_number() OVER (ORDER BY n_nationkey || '.xml') AS docid, n.* FROM nation n"


#: Engines that queries only read, by session and tables.
WORLDS: dict[tuple[str, str], Engine] = {}


def known_world(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in WORLDS:
        WORLDS[key] = world(spark, sf_dir)
    return WORLDS[key]


def world(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, load_catalog(WORLD.format(d="/w")), folder(spark, "engine"))
    engine.put_documents("nations", nations(spark, sf_dir))
    engine.put_documents("regions", regions(spark, sf_dir))
    return engine


@query(f"SELECT docid FROM ({IDS}) WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name >= 'ASIA') AND n_nationkey > 5 AND n_nationkey % 2 <> 0")
def engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML documents are put, indexed, and asked across two docbases."""
    return known_world(spark, sf_dir).query('regions.rname >= ASIA & key > 5 & even != ""', "nations").docids


@query(f"SELECT docid, n_nationkey || '.xml' AS name, n_name AS key FROM ({IDS}) WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT docid, CASE rn WHEN 1 THEN 'a.xml' ELSE 'b.xml' END, CASE rn WHEN 1 THEN 'A' ELSE 'B' END FROM (SELECT docid, row_number() OVER (ORDER BY docid) AS rn FROM ({IDS}) WHERE n_nationkey IN (3, 4))")
def engine_delete_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents leave no keys, and new ones get the freed ids."""
    engine = world(spark, sf_dir)
    engine.delete_documents("nations", ["/w/nations/3.xml", "4.xml", "unknown.xml"])
    engine.put_documents("nations", spark.createDataFrame([("b.xml", "<nation><name>B</name></nation>"), ("a.xml", "<nation><name>A</name></nation>")], "name string, content string"))
    base = engine.bases()["nations"]
    return base.table.select("docid", "name").join(base.keys("name"), "docid")


@query("""SELECT * FROM (VALUES ('nations', 30::BIGINT, 25::BIGINT, 26::BIGINT, 'name', 25::BIGINT), ('nations', 30, 25, 26, 'key', 25), ('nations', 30, 25, 26, 'even', 1), ('nations', 30, 25, 26, 'region', 5),
    ('regions', 30000, 5, 6, 'region', 5), ('regions', 30000, 5, 6, 'rname', 5)) t(base, capacity, documents, next_docid, index, keys)""")
def engine_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_world(spark, sf_dir).describe().select("base", "capacity", "documents", "next_docid", "index", "keys")


@query(f"""SELECT 'head' AS section, 'nations /w/nations capacity 30 next 26 links region' AS line UNION ALL SELECT 'map', docid || ' ' || n_nationkey || '.xml' FROM ({IDS})
    UNION ALL SELECT 'index region', n_regionkey || ':' || string_agg(docid::VARCHAR, ' ' ORDER BY docid) FROM ({IDS}) GROUP BY n_regionkey UNION ALL SELECT 'index name', n_name || ':' || docid FROM ({IDS})
    UNION ALL SELECT 'index key', n_nationkey || ':' || docid FROM ({IDS}) UNION ALL SELECT 'index even', ':' || string_agg(docid::VARCHAR, ' ' ORDER BY docid) FROM ({IDS}) WHERE n_nationkey % 2 = 0""")
def docbase_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header with links, the map of ids, and all indexes."""
    return known_world(spark, sf_dir).dump("nations")


def lines(spark: SparkSession, found: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(found)), "n long, line string")


def script(spark: SparkSession, sf_dir: str) -> str:
    """Statements that put the nations of each region into an index."""
    own = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))), " ").alias("d")).collect()
    return "new r uint8 100; put r " + " ".join(f"({x['n_regionkey']}:{x['d']})" for x in own) + ";"


PER_REGION = "SELECT n_regionkey AS k, n_regionkey || ':' || string_agg((n_nationkey + 1)::VARCHAR, ' ' ORDER BY n_nationkey) AS line FROM nation GROUP BY 1"


@query(f"SELECT CASE k WHEN 3 THEN 0::BIGINT WHEN 1 THEN 1 END AS n, line FROM ({PER_REGION}) WHERE k IN (1, 3) UNION ALL SELECT 2, '77:' UNION ALL SELECT 3, 'index r version 2 type uint8 capacity 100 keys ' || count(*) FROM ({PER_REGION}) UNION ALL SELECT 3 + row_number() OVER (ORDER BY k), line FROM ({PER_REGION})")
def shell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new, put, get, show; nothing after quit."""
    s = shell.Shell(spark, folder(spark, "shell"))
    return lines(spark, list(s.run(script(spark, sf_dir) + "get r 3 1 77; show r; quit; get r 1;")))


@query("SELECT 0::BIGINT AS n, '1:' || string_agg((n_nationkey + 1)::VARCHAR, ' ' ORDER BY n_nationkey) AS line FROM nation WHERE n_regionkey = 1 AND n_nationkey NOT IN (1, 2)")
def shell_unput_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements from the command line; what a put and its opposite leave."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        shell.main(["--root", folder(spark, "shell"), "-e", script(spark, sf_dir) + "unput r (1:2 3); get r 1"])
    return lines(spark, out.getvalue().splitlines())


@query(f"SELECT 0::BIGINT AS n, 'nations: version 1' AS line UNION ALL SELECT 1, 'nations: version 2' UNION ALL SELECT 2, '<results count=\"' || count(*) || '\">' FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 12 UNION ALL SELECT 2 + row_number() OVER (ORDER BY docid), {CONTENT} FROM ({IDS}) WHERE n_regionkey = 2 AND n_nationkey <> 12 UNION ALL SELECT 3 + count(*), '</results>' FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 12 UNION ALL SELECT 4 + (SELECT count(*) FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 12) + rn, line FROM (VALUES (0, 'nations 24 even 1'), (1, 'nations 24 key 24'), (2, 'nations 24 name 24'), (3, 'nations 24 region 5'), (4, 'regions 0 region 0'), (5, 'regions 0 rname 0')) t(rn, line)")
def shell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """putdoc by a pattern, deldoc, query and info."""
    root = nation_files(spark, sf_dir)
    s = shell.Shell(spark, folder(spark, "shell"), load_catalog(WORLD.format(d="/w").replace("/w/nations", root)))
    found = list(s.run(f"putdoc {root}/*.xml; deldoc {root}/12.xml; query nations region = 2; info;"))
    short = []
    for line in found:
        if line.startswith("base="):
            own = dict(p.split("=", 1) for p in line.split(" "))
            line = f"{own['base']} {own['documents']} {own['index']} {own['keys']}"
        short.append(line.split(" querytime")[0] + ">" if "querytime" in line else line)
    return lines(spark, short)


__all__ = ["ORACLE_SQL", "QUERIES"]  # those of the catalogue, with the ones above
