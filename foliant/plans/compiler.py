"""From query trees to DataFrames of document ids.

Terms of one docbase are fused into one plan, however deep the tree is:

* single-valued indexes are columns of the docbase's table and become one filter, pushed down to
  the scan (negated leaves alone are guarded against nulls);
* multi-valued indexes of one postings table become one aggregation, ``bool_or`` of each term by
  document, instead of a join for each;
* the universe of all documents is joined only if the tree holds for documents without keys.

Across docbases results are converted through an index of the same name, as semi-joins.  The
largest subtree that is wholly of another docbase is answered there (so that all its terms hold
for one document of it) and then converted.  A negation around it is a complement in the docbase
that is asked: ``!q`` holds for exactly the documents that ``q`` does not hold for.  A term with
``!=`` is the other docbase's own complement, as any term is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_type
from ..operators import docset
from .parser import parse
from .tree import And, Node, Not, Or, Pair, Term, Xor, check, rewrite

COMPARE = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Postings:
    """A multi-valued index: a key column of a table with a row for each (document, key)."""

    table: DataFrame
    docid: str
    key: str
    type: str


@dataclass
class Base:
    """A docbase: a table with a row for each document, its single-valued indexes (name ->
    (column, type)) and its multi-valued ones.

    ``closed`` states that postings name documents of the table alone, as a store keeps them
    (:meth:`strays` checks it); then one positive term needs no join.  Otherwise every result
    is met with the table.
    """

    name: str
    table: DataFrame
    docid: str
    single: dict[str, tuple[str, str]] = field(default_factory=dict)
    many: dict[str, Postings] = field(default_factory=dict)
    closed: bool = True

    def universe(self) -> DataFrame:
        return self.table.select(F.col(self.docid).alias("docid"))

    def keys(self, index: str) -> DataFrame:
        """``docid, key`` of an index."""
        if index in self.single:
            column = self.single[index][0]
            return self.table.where(F.col(column).isNotNull()).select(F.col(self.docid).alias("docid"), F.col(column).alias("key"))
        p = self._many(index)
        return p.table.where(F.col(p.key).isNotNull()).select(F.col(p.docid).alias("docid"), F.col(p.key).alias("key"))

    def strays(self) -> DataFrame:
        """``index, docid``: postings of documents that the table does not have."""
        out = self.universe().limit(0).select(F.lit("").alias("index"), "docid")
        for name in self.many:
            found = self.keys(name).select("docid").distinct().join(self.universe(), "docid", "left_anti")
            out = out.union(found.select(F.lit(name).alias("index"), "docid"))
        return out

    def cell(self, index: str, docids: DataFrame) -> DataFrame:
        """``docid, key`` for each asked document: the keys by which it refers to others; null if
        it has none."""
        return docids.select("docid").distinct().join(self.keys(index).distinct(), "docid", "left")

    def _many(self, index: str) -> Postings:
        if index not in self.many:
            raise KeyError(f"docbase {self.name} has no index {index}; it has {sorted([*self.single, *self.many])}")
        return self.many[index]


def compare(column: Column, op: str, type_name: str, text: str) -> Column:
    t = key_type(type_name)
    return COMPARE[op](column, F.lit(t.literal(str(text))).cast(t.spark))


def _holds(node: Node, flags: dict[Term, bool]) -> bool:
    if isinstance(node, Term):
        return flags[node]
    if isinstance(node, Not):
        return not _holds(node.child, flags)
    assert isinstance(node, Pair)
    a, b = _holds(node.left, flags), _holds(node.right, flags)
    return a and b if isinstance(node, And) else a or b if isinstance(node, Or) else a != b


def _expression(node: Node, leaf: dict[Term, Column]) -> Column:
    if isinstance(node, Term):
        return leaf[node]
    if isinstance(node, Not):
        return ~F.coalesce(_expression(node.child, leaf), F.lit(False))
    assert isinstance(node, Pair)
    a, b = _expression(node.left, leaf), _expression(node.right, leaf)
    if isinstance(node, And):
        return a & b
    if isinstance(node, Or):
        return a | b
    return F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))


class Compiler:
    def __init__(self, bases: Mapping[str, Base], dialect: str = "all"):
        self.bases, self.dialect = bases, dialect

    def base(self, name: str) -> Base:
        if name not in self.bases:
            raise KeyError(f"no docbase {name}; there are {sorted(self.bases)}")
        return self.bases[name]

    def query(self, node: Node | str, base: str) -> DataFrame:
        """Distinct ``docid`` of the documents of ``base`` that a query holds for."""
        tree = check(parse(node) if isinstance(node, str) else node)
        found, negated = self._fetch(tree, base)
        return docset.subtract(self.base(base).universe(), found) if negated else found

    def _fetch(self, node: Node, base: str) -> tuple[DataFrame, bool]:
        """A set of documents, and whether its complement is meant: complements meet the
        universe at the very end, if at all."""
        names = {t.base or base for t in node.terms()}
        if names == {base}:
            return self._fused(rewrite(_plain(node), self.dialect), self.base(base)), False
        if isinstance(node, Not):
            found, negated = self._fetch(node.child, base)
            return found, not negated
        if len(names) == 1:  # wholly of another docbase: answered there, then converted
            other = names.pop()
            found, _ = self._fetch(_plain(node), other)
            return self.convert(found, other, base), False
        assert isinstance(node, Pair)
        (a, not_a), (b, not_b) = self._fetch(node.left, base), self._fetch(node.right, base)
        if isinstance(node, Xor):
            return docset.xor(a, b), not_a != not_b
        flip = isinstance(node, Or)  # a | b = !(!a & !b)
        not_a, not_b = not_a != flip, not_b != flip
        if not_a and not_b:
            return docset.union(a, b), not flip
        found = docset.subtract(a, b) if not_b else docset.subtract(b, a) if not_a else docset.intersect(a, b)
        return found, flip

    def convert(self, found: DataFrame, source: str, target: str, index: str | None = None) -> DataFrame:
        """Documents of ``target`` that share a key with documents found in ``source``, through
        an index that both have."""
        a, b = self.base(source), self.base(target)
        shared = sorted({*a.single, *a.many} & {*b.single, *b.many})
        name = index or (shared[0] if shared else None)
        if name is None or name not in shared:
            raise KeyError(f"{source} and {target} share no index{' ' + index if index else ''}")
        keys = a.keys(name).join(found, "docid", "left_semi").select("key").distinct()
        return b.keys(name).join(keys, "key", "left_semi").select("docid").distinct()

    def _fused(self, node: Node, base: Base) -> DataFrame:
        terms = list(dict.fromkeys(node.terms()))
        leaf: dict[Term, Column] = {}
        groups: dict[tuple[int, str], list[tuple[Term, Column]]] = {}
        tables: dict[tuple[int, str], Postings] = {}
        for t in terms:
            if t.index in base.single:
                column, kind = base.single[t.index]
                leaf[t] = compare(F.col(column), t.op, kind, t.value)
            else:
                p = base._many(t.index)
                key = (id(p.table), p.docid)
                tables[key] = p
                groups.setdefault(key, []).append((t, compare(F.col(p.key), t.op, p.type, t.value)))
        if not groups:
            return base.table.where(_expression(node, leaf)).select(F.col(base.docid).alias("docid"))
        if isinstance(node, Term):  # one positive term: a filter on its postings
            p = base._many(node.index)
            return self._met(p.table.where(groups[id(p.table), p.docid][0][1]).select(F.col(p.docid).alias("docid")).distinct(), base)
        frames = []
        for n, (key, own) in enumerate(groups.items()):
            p = tables[key]
            some = own[0][1]
            for _, c in own[1:]:
                some = some | c
            names = [f"t{n}_{k}" for k in range(len(own))]
            # rows that meet no term change no flag: they are filtered at the scan
            flags = p.table.where(some).groupBy(F.col(p.docid).alias("docid")).agg(*[F.bool_or(c).alias(name) for name, (_, c) in zip(names, own, strict=True)])
            frames.append(flags)
            leaf |= {t: F.coalesce(F.col(name), F.lit(False)) for name, (t, _) in zip(names, own, strict=True)}
        if len(frames) == 1 and len(leaf) == sum(map(len, groups.values())) and not _holds(node, dict.fromkeys(terms, False)):
            return self._met(frames[0].where(_expression(node, leaf)).select("docid"), base)
        needed = sorted({base.single[t.index][0] for t in terms if t.index in base.single})
        out = base.table.select(F.col(base.docid).alias("docid"), *[c for c in needed if c != base.docid], *([F.col(base.docid)] if base.docid in needed and base.docid != "docid" else []))
        for flags in frames:
            out = out.join(flags, "docid", "left")
        return out.where(_expression(node, leaf)).select("docid")

    def _met(self, found: DataFrame, base: Base) -> DataFrame:
        return found if base.closed else found.join(base.universe(), "docid", "left_semi")


def _plain(node: Node) -> Node:
    """The tree as its own docbase sees it."""
    if isinstance(node, Term):
        return Term(node.index, node.op, node.value)
    if isinstance(node, Not):
        return Not(_plain(node.child))
    assert isinstance(node, Pair)
    return type(node)(_plain(node.left), _plain(node.right))


__all__ = ["Base", "Compiler", "Postings", "compare"]
