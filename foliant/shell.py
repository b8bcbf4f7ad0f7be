"""The command language: statements end with ``;``.

    new <index> <type> <capacity>          show <index>
    put <index> (<key>:<docid> ...) ...    unput <index> (<key>:<docid> ...) ...
    get <index> <key> ...                  info
    putdoc <file or glob>                  deldoc <file>
    query <docbase> <query text>           quit

    python -m foliant.shell --root DIR [--catalog FILE] -e "get year 1999;"
"""

from __future__ import annotations

import argparse
import glob
import os
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.keys import key_text, key_type
from .operators import index
from .operators.store import Store
from .plans.catalog import Catalog, load_catalog
from .storage import stored

GROUP = re.compile(r"\(\s*(\"(?:[^\"\\]|\\.)*\"|[^\s:()]+)\s*:\s*([\d\s]+)\)")


class CommandError(ValueError):
    """A statement that is not understood."""


class Shell:
    """Commands over single indexes (each a store of its own) and over an engine's docbases."""

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None, dialect: str = "all"):
        self.spark, self.root = spark, root.rstrip("/")
        self.engine = Engine(spark, catalog or Catalog(), f"{self.root}/bases", dialect)
        self.commands = {n: getattr(self, f"do_{n}") for n in ("new", "show", "put", "unput", "get", "putdoc", "deldoc", "query", "info")}

    # single indexes

    def _store(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/indexes/{name}")

    def _load(self, name: str) -> tuple[Store, int, DataFrame, str, int]:
        store = self._store(name)
        version = store.version()
        if not version:
            raise KeyError(f"no index {name}")
        meta = store.docs(version).first()
        return store, version, store.index("postings", version), meta["type"], meta["capacity"]

    def _save(self, store: Store, version: int | None, postings: DataFrame, kind: str, capacity: int) -> None:
        store.commit(self.spark.createDataFrame([(kind, capacity)], "type string, capacity long"), {"postings": postings}, expected=version)

    def _entries(self, groups: str, kind: str, capacity: int) -> DataFrame:
        rest = GROUP.sub("", groups).strip()
        if rest:
            raise CommandError(f"unexpected {rest!r}")
        t, rows = key_type(kind), []
        for key, docids in GROUP.findall(groups):
            for d in map(int, docids.split()):
                if not 1 <= d <= capacity:
                    raise CommandError(f"docid {d} is not in 1..{capacity}")
                rows.append((t.literal(_unquoted(key)), d))
        return self.spark.createDataFrame(rows, f"key {t.spark}, docid long")

    def do_new(self, rest: str) -> Iterator[str]:
        name, kind, capacity = rest.split()
        t = key_type(kind)
        empty = self.spark.createDataFrame([], f"key {t.spark}, docid long")
        self._save(self._store(name), None, empty, t.name, int(capacity))
        yield from ()

    def do_show(self, rest: str) -> Iterator[str]:
        _, version, postings, kind, capacity = self._load(rest.strip())
        rows = stored(index.show(postings).select("key", key_text(F.col("key"), kind).alias("text"), "docids"), "show")
        yield f"index {rest.strip()} version {version} type {kind} capacity {capacity} keys {rows.count()}"
        for r in rows.orderBy("key").select("text", "docids").toLocalIterator():
            yield f"{r['text']}:{r['docids']}"

    def do_put(self, rest: str) -> Iterator[str]:
        name, _, groups = rest.strip().partition(" ")
        store, version, postings, kind, capacity = self._load(name)
        self._save(store, version, index.put(postings, self._entries(groups, kind, capacity)), kind, capacity)
        yield from ()

    def do_unput(self, rest: str) -> Iterator[str]:
        name, _, groups = rest.strip().partition(" ")
        store, version, postings, kind, capacity = self._load(name)
        self._save(store, version, index.unput(postings, self._entries(groups, kind, capacity)), kind, capacity)
        yield from ()

    def do_get(self, rest: str) -> Iterator[str]:
        name, *keys = re.findall(r'"(?:[^"\\]|\\.)*"|\S+', rest)
        _, _, postings, kind, _ = self._load(name)
        t = key_type(kind)
        asked = self.spark.createDataFrame([(n, t.literal(_unquoted(k))) for n, k in enumerate(keys)], f"n int, key {t.spark}")
        found = index.show(postings.join(F.broadcast(asked.select("key")), "key", "left_semi"))
        for r in asked.join(found, "key", "left").orderBy("n").select(key_text(F.col("key"), kind).alias("text"), "docids").collect():
            yield f"{r['text']}:{r['docids'] or ''}"

    # docbases

    def do_putdoc(self, rest: str) -> Iterator[str]:
        pattern = os.path.expanduser(rest.strip())
        files = sorted(os.path.abspath(f) for f in glob.glob(pattern))
        if not files:
            raise CommandError(f"no file matches {pattern}")
        for base, version in self.engine.put_files(files).items():
            yield f"{base}: version {version}"

    def do_deldoc(self, rest: str) -> Iterator[str]:
        path = os.path.abspath(os.path.expanduser(rest.strip()))
        base = self.engine.catalog.by_directory(os.path.dirname(path)).name
        yield f"{base}: version {self.engine.delete_documents(base, [path])}"

    def do_query(self, rest: str) -> Iterator[str]:
        base, _, text = rest.strip().partition(" ")
        yield from self.engine.query(text, base).xml()

    def do_info(self, rest: str) -> Iterator[str]:
        for r in self.engine.describe().orderBy("base", "index").collect():
            yield " ".join(f"{k}={v}" for k, v in r.asDict().items())

    def run(self, text: str) -> Iterator[str]:
        """Output lines of all statements; ``quit`` or ``exit`` ends."""
        for statement in re.findall(r'((?:"(?:[^"\\]|\\.)*"|[^;"])*);', text if text.rstrip().endswith(";") else text + ";"):
            name, _, rest = statement.strip().partition(" ")
            if name in ("quit", "exit"):
                return
            if name and name not in self.commands:
                raise CommandError(f"unknown command {name!r}")
            if name:
                yield from self.commands[name](rest)


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if text.startswith('"') else text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", required=True, help="folder of the stores")
    p.add_argument("--catalog", help="XML file of docbases")
    p.add_argument("-e", "--expression", help="statements to run; without it they are read from standard input")
    a = p.parse_args(argv)
    shell = Shell(SparkSession.builder.getOrCreate(), a.root, load_catalog(a.catalog) if a.catalog else None)
    for line in shell.run(a.expression if a.expression is not None else sys.stdin.read()):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
