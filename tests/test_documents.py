"""Sources, ids, stores, the engine, the shell and streaming ingest."""

import random

import pytest

from foliant.engine import Engine
from foliant.functions.keys import key_type
from foliant.operators import docbase, index
from foliant.operators.store import ConflictError, Store
from foliant.plans.catalog import load_catalog
from foliant.shell import CommandError, Shell
from foliant.sources import documents as D
from foliant.streaming.ingest import document_stream, ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_texts():
    x = "<r><k>a<b>b</b>c</k><k/><k x='1'>d</k><m><k>e</k></m></r>"
    assert D.select_texts(x, "/r/k") == ["abc", "", "d"]
    assert D.select_texts(x, "//k") == ["abc", "", "d", "e"]
    assert D.select_texts(x, "/r/k/@x") == ["1"] and D.select_texts(x, "/r/m/k/text()") == ["e"]
    assert D.select_texts(x, "/q/k") == [] and D.select_texts("<r>", "/r") is None and D.select_texts(None, "/r") is None


def test_tsv_and_lines(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text('id title tag\n1\ta & "b"\n2\t<é>\tx\textra\n', encoding="utf-8")
    assert rows(D.read_tsv(spark, str(f))) == [("1", 'a & "b"', ""), ("2", "<é>", "x")]
    assert rows(D.read_tsv(spark, str(f), ascii=True))[1][1] == "<>"
    made = rows(D.rows_as_xml(D.read_tsv(spark, str(f)), "rec"))
    assert ('<rec><id>1</id><title>a &amp; "b"</title><tag></tag></rec>',) in made
    g = tmp_path / "l.txt"
    g.write_text("one\ntwo\n")
    assert rows(D.read_lines(spark, str(g))) == [("1.xml", "one"), ("2.xml", "two")]


def test_records_and_entries(spark, tmp_path):
    f = tmp_path / "big.xml"
    f.write_text("<S><C n='1'><a>x</a></C>\n <C><a>y</a></C><C><a>z</a></C></S>")
    assert rows(D.read_records(spark, str(f), "C")) == [(1, "<C n='1'><a>x</a></C>"), (2, "<C><a>y</a></C>"), (3, "<C><a>z</a></C>")]
    e = tmp_path / "e.xml"
    e.write_text('<entries><entry><key type="text">K</key><file>/p/12.xml</file></entry><entry><key type="text">K</key><file>/p/12.xml</file></entry><entry><file>/p/3.xml</file></entry></entries>')
    assert rows(D.read_entries(spark, str(e))) == [("K", 12), ("K", 12), ("NOTFOUND", 3)]
    out = str(tmp_path / "out")
    D.write_entries(spark.createDataFrame([("a", "/x/1.xml"), ("b", "/x/2.xml")], "key string, file string"), out)
    assert rows(D.read_entries(spark, out)) == [("a", 1), ("b", 2)]


def test_allocation(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (5, "c", "x")], "docid long, name string, content string")
    names = spark.createDataFrame([("d",), ("b",), ("e",), ("f",)], "name string")
    assert rows(docbase.allocate(docs, names, 10)) == [("d", 3), ("e", 4), ("f", 6)]
    assert docbase.lowest_free(docs, 5).first()[0] == 3
    with pytest.raises(docbase.CapacityError):
        docbase.allocate(docs, names, 5)
    used = spark.range(1, 10_001).where("id % 5000 <> 0").selectExpr("id AS docid", "CAST(id AS STRING) AS name", "'' AS content")
    assert rows(docbase.allocate(used, names.limit(3), 1 << 40)) == [("b", 5000), ("d", 10000), ("e", 10001)]
    batch = spark.createDataFrame([("b", "new"), ("z", "z1")], "name string, content string")
    assert rows(docbase.upsert(docs, batch, 10)) == [(1, "a", "x"), (2, "b", "new"), (3, "z", "z1"), (5, "c", "x")]


@pytest.mark.parametrize("kind", ["int8", "uint64", "double", "char8", "date", "string"])
def test_random_round_trip(spark, tmp_path, kind):
    """Entries put into a stored index are what a dictionary holds."""
    rng, t, want = random.Random(kind), key_type(kind), {}
    entries = []
    for _ in range(30):
        text = "".join(rng.choices("abc012789", k=rng.randint(1, 10))) if kind in ("char8", "string") else str(rng.randint(-300, 20990101))
        key = t.literal(text)
        for d in rng.choices(range(1, 101), k=5):
            entries.append((key, d))
            want.setdefault(key, set()).add(d)
    store = Store(spark, str(tmp_path / kind))
    df = spark.createDataFrame(entries, f"key {t.spark}, docid long")
    store.commit(df, {"i": index.put(index.build(df), df)})
    again = store.index("i")
    assert {(r.key, r.docid) for r in again.collect()} == {(k, d) for k, ds in want.items() for d in ds}
    gone = spark.createDataFrame([(d,) for d in range(1, 51)], "docid long")
    left = {(k, d) for k, ds in want.items() for d in ds if d > 50}
    assert {(r.key, r.docid) for r in index.delete(again, gone).collect()} == left


def test_a_task_has_no_more_postings_in_a_larger_index(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr("foliant.storage.SHARE", 20_000, raising=False)
    most = []
    for n in (40_000, 160_000):
        ids = spark.range(n).select((F.col("id") % 7).cast("double").alias("key"), F.floor(F.col("id") / 2).alias("docid"))
        ids.union(ids.where("docid % 5 = 0")).coalesce(1).write.parquet(str(tmp_path / str(n)))
        table = spark.read.parquet(str(tmp_path / str(n)))
        touched = table.where("docid % 3 = 0").select("docid")
        fresh = index.restrict(table.withColumn("key", F.col("key") + 100), touched)
        out = docbase.reindex(index.build(table), fresh, touched)
        want = {(i % 7 + (100.0 if i // 2 % 3 == 0 else 0.0), i // 2) for i in range(n)}
        got = out.collect()
        assert {(r.key, r.docid) for r in got} == want and len(got) == len(want)
        most.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
    assert most[1] < 2 * most[0]


def test_store_guards_against_lost_updates(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, 1)], "key int, docid long")
    assert s.version() == 0 and s.commit(one, {"i": one}, expected=0) == 1
    with pytest.raises(RuntimeError):
        s.commit(one, {"i": one}, expected=0)
    # a writer that saw the same version, but comes to publishing second
    late = Store(spark, s.root)
    late.version = lambda: 0
    with pytest.raises(ConflictError):
        late.commit(one, {"i": one}, expected=0)
    assert s.version() == 1 and [tuple(r) for r in s.index("i").collect()] == [(1, 1)]
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_new")]


CATALOG = """<c><documents name="recipes" dir="{d}/recipes" capacity="5"><indexes><index name="id" type="string"><key>/recipe/id</key></index>
 <index name="tag" type="string"><key>/recipe/tag</key></index><index name="year" type="uint16"><key>/recipe/@year</key></index></indexes></documents>
 <documents name="reviews" dir="{d}/reviews"><indexes><index name="id" type="string"><key>/review/id</key></index><index name="rating" type="uint8"><key>/review/rating</key></index></indexes></documents></c>"""


def test_engine_and_shell(spark, tmp_path):
    (tmp_path / "recipes").mkdir()
    (tmp_path / "reviews").mkdir()
    docs = {"a": '<recipe year="1999"><id>r1</id><tag>x</tag><tag>y</tag></recipe>', "b": '<recipe year="2001"><id>r2</id><tag/></recipe>', "c": "<recipe><id>broken</recipe>"}
    for n, c in docs.items():
        (tmp_path / "recipes" / f"{n}.xml").write_text(c)
    (tmp_path / "reviews" / "v.xml").write_text("<review><id>r2</id><rating>5</rating></review>")
    shell = Shell(spark, str(tmp_path / "root"), load_catalog(CATALOG.format(d=tmp_path)))
    assert list(shell.run(f"putdoc {tmp_path}/recipes/*.xml; putdoc {tmp_path}/reviews/*.xml;")) == ["recipes: version 1", "reviews: version 1"]
    ask = lambda t: sorted(r.docid for r in shell.engine.query(t, "recipes").docids.collect())
    assert ask("tag = x & year < 2000") == [1] and ask("tag != x") == [2, 3] and ask('tag = ""') == [2]
    assert ask("year < 2000") == [1, 3]  # no key at all: nothing speaks against it
    assert ask("reviews.rating = 5") == [2]
    out = list(shell.run("query recipes tag = y;"))
    assert out[0].startswith('<results count="1"') and out[1] == docs["a"] and out[-1] == "</results>"
    (tmp_path / "recipes" / "a.xml").write_text(docs["a"].replace("x", "w"))
    list(shell.run(f"putdoc {tmp_path}/recipes/a.xml; deldoc {tmp_path}/recipes/b.xml"))
    assert ask("tag = x") == [] and ask("tag = w") == [1] and ask("id != zz") == [1, 3]
    (tmp_path / "recipes" / "n.xml").write_text("<recipe><id>r9</id></recipe>")
    list(shell.run(f"putdoc {tmp_path}/recipes/n.xml"))
    assert ask("id = r9") == [2]  # the freed id
    assert any("base=recipes" in line and "next_docid=4" in line for line in shell.run("info"))
    with pytest.raises(CommandError):
        list(shell.run("nonsense 1;"))


def test_index_commands(spark, tmp_path):
    s = Shell(spark, str(tmp_path / "r"))
    assert list(s.run('new y uint16 100; put y (1999:1 2 3) (2001:3) (1999:2); get y 1999 2001 5;')) == ["1999:1 2 3", "2001:3", "5:"]
    assert list(s.run("unput y (1999:1 3) (2001:3); get y 1999 2001; quit; get y 1;")) == ["1999:2", "2001:"]
    assert list(s.run("show y;"))[1:] == ["1999:2"]
    with pytest.raises(CommandError):
        list(s.run("put y (1:101);"))
    with pytest.raises(ValueError):
        list(s.run("new z int128 10;"))


def test_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.xml").write_text('<recipe year="7"><id>s1</id></recipe>')
    engine = Engine(spark, load_catalog(CATALOG.format(d=tmp_path)), str(tmp_path / "root"))
    writer = lambda: ingest(document_stream(spark, str(inbox)), engine, "recipes", str(tmp_path / "cp")).trigger(availableNow=True).start()
    writer().awaitTermination()
    (inbox / "b.xml").write_text('<recipe year="8"><id>s2</id></recipe>')
    writer().awaitTermination()
    assert sorted(r.docid for r in engine.query("year >= 7", "recipes").docids.collect()) == [1, 2]


def test_stored_tables_are_dropped(spark):
    from pathlib import Path

    from foliant.storage import TABLES, drop_since, mark, stored

    first, point = stored(spark.range(5), "a"), mark()
    second = stored(first.where("id > 1"), "b")
    third = stored(second.where("id > 2"), "c")
    gone, kept = TABLES[point], TABLES[point + 1]
    drop_since(spark, point, third)
    assert TABLES[point:] == [kept] and not Path(gone).exists() and third.count() == 2 and first.count() == 5
