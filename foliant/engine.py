"""Docbases over a store: put, delete, query, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import key_text, key_type
from .operators import docbase, index
from .operators.results import Results
from .operators.store import Store
from .plans.catalog import Catalog, IndexDef
from .plans.compiler import Base, Compiler, Postings
from .plans.tree import Node
from .sources.documents import extract_keys, read_documents
from .storage import stored


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, dialect: str = "all", mode: str = "c_prefix"):
        self.spark, self.catalog, self.root, self.dialect, self.mode = spark, catalog, root.rstrip("/"), dialect, mode

    def store(self, base: str) -> Store:
        return Store(self.spark, f"{self.root}/{self.catalog.by_name(base).name}")

    def _state(self, base: str) -> tuple[Store, int, DataFrame, dict[str, DataFrame]]:
        store, definition = self.store(base), self.catalog.by_name(base)
        version = store.version()
        if version:
            return store, version, store.docs(version), {n: store.index(n, version) for n in definition.indexes}
        empty = {n: self.spark.createDataFrame([], f"key {key_type(i.type).spark}, docid long") for n, i in definition.indexes.items()}
        return store, 0, self.spark.createDataFrame([], "docid long, name string, content string"), empty

    def put_documents(self, base: str, batch: DataFrame) -> int:
        """Upsert ``name, content`` and index it; the new version."""
        store, version, docs, postings = self._state(base)
        definition = self.catalog.by_name(base)
        after = docbase.upsert(docs, batch, definition.capacity)
        after = stored(after, "after")  # each index reads it
        touched = after.join(batch.select("name").distinct(), "name", "left_semi").select("docid", "content")
        fresh = {n: docbase.reindex(postings[n], extract_keys(touched, i, self.mode), touched) for n, i in definition.indexes.items()}
        for n, i in definition.indexes.items():
            if i.unique and index.duplicates(fresh[n]).limit(1).count():
                raise ValueError(f"index {n} is unique, but a key has several documents")
        return store.commit(after, fresh, expected=version)

    def put_files(self, files: list[str]) -> dict[str, int]:
        """Files by docbase of their folders."""
        return {base: self.put_documents(base, read_documents(self.spark, own)) for base, own in self.catalog.route(sorted(files)).items()}

    def delete_documents(self, base: str, names: list[str]) -> int:
        store, version, docs, postings = self._state(base)
        gone = self.spark.createDataFrame([(n.rpartition("/")[2],) for n in names], "name string")
        ids = docs.join(gone, "name", "left_semi").select("docid")
        return store.commit(docbase.delete(docs, gone), {n: index.delete(p, ids) for n, p in postings.items()}, expected=version)

    def bases(self) -> dict[str, Base]:
        out = {}
        for name, d in self.catalog.bases.items():
            _, _, docs, postings = self._state(name)
            out[name] = Base(name, docs, "docid", {}, {n: Postings(postings[n], "docid", "key", d.indexes[n].type) for n in d.indexes})
        return out

    def query(self, text: str | Node, base: str) -> Results:
        bases = self.bases()
        return Results(Compiler(bases, self.dialect).query(text, base), bases[base].table)

    def dump(self, base: str) -> DataFrame:
        """``section, line``: what a docbase has.  Its header (folder, capacity, next free id, the
        indexes that lead to other docbases), the map of ids to names, and each index."""
        definition, (_, _, docs, postings) = self.catalog.by_name(base), self._state(base)
        links = " ".join(n for n, own in self.catalog.links().items() if base in own)
        free = docbase.lowest_free(docs, definition.capacity)
        head = free.select(F.lit("head").alias("section"), F.concat_ws(" ", F.lit(base), F.lit(definition.directory), F.lit("capacity"), F.lit(definition.capacity), F.lit("next"), "docid", F.lit("links"), F.lit(links)).alias("line"))
        out = head.union(docs.select(F.lit("map"), F.concat_ws(" ", "docid", "name")))
        for n, i in definition.indexes.items():
            rows = index.show(postings[n])
            out = out.union(rows.select(F.lit(f"index {n}"), F.concat(key_text(F.col("key"), i.type), F.lit(":"), "docids")))
        return out

    def describe(self) -> DataFrame:
        """``base, directory, capacity, documents, next_docid, index, type, path, keys``."""
        rows = []
        for name, d in self.catalog.bases.items():
            _, _, docs, postings = self._state(name)
            documents, free = docs.count(), docbase.lowest_free(docs, d.capacity).first()[0]
            for i in d.indexes.values() or [IndexDef("", "string", "")]:
                keys = postings[i.name].select("key").distinct().count() if i.name else 0
                rows.append((name, d.directory, d.capacity, documents, free, i.name, i.type, i.path, keys))
        return self.spark.createDataFrame(rows, "base string, directory string, capacity long, documents long, next_docid long, index string, type string, path string, keys long")
