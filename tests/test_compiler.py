"""Truth tables and algebraic laws of compiled queries, against sets in Python."""

import random

import pytest

from foliant.plans.compiler import Base, Compiler, Postings
from foliant.plans.parser import parse
from foliant.plans.tree import And, Not, Or, Pair, Term, Xor

DOCS = {1: [], 2: [5], 3: [10], 4: [5, 10], 5: [12], 6: [5, 12], 7: [10, 12], 8: [3, 4]}
SINGLE = {d: (d % 3 if d != 5 else None) for d in DOCS}
OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def bases(spark):
    table = spark.createDataFrame([(d, SINGLE[d]) for d in DOCS], "id long, s int").cache()
    keys = spark.createDataFrame([(d, k, k * 2) for d, ks in DOCS.items() for k in ks], "doc long, k long, l long").cache()
    return {"b": Base("b", table, "id", {"s": ("s", "int32")}, {"k": Postings(keys, "doc", "k", "int64"), "l": Postings(keys, "doc", "l", "int64")})}


def keys_of(d, index):
    return DOCS[d] if index == "k" else [2 * x for x in DOCS[d]] if index == "l" else [] if SINGLE[d] is None else [SINGLE[d]]


def oracle(node, dialect):
    if isinstance(node, Term):
        v, c = {d: keys_of(d, node.index) for d in DOCS}, int(node.value)
        if node.op == "!=":
            return {d for d in DOCS if c not in v[d]}
        if dialect == "all" and node.op in ("<", "<="):
            return {d for d in DOCS if all(OPS[node.op](x, c) for x in v[d])}
        return {d for d in DOCS if any(OPS[node.op](x, c) for x in v[d])}
    if isinstance(node, Not):
        return set(DOCS) - oracle(node.child, dialect)
    a, b = oracle(node.left, dialect), oracle(node.right, dialect)
    return a & b if isinstance(node, And) else a | b if isinstance(node, Or) else a ^ b


def found(bases, node, dialect="all"):
    rows = [r.docid for r in Compiler(bases, dialect).query(node, "b").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("dialect", ["all", "any"])
@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
def test_truth_table(bases, op, dialect):
    for index in ("k", "s"):
        for value in ("1", "5", "7", "10", "12", "99"):  # keys and others, below, between and above
            t = Term(index, op, value)
            assert found(bases, t, dialect) == oracle(t, dialect), (index, op, value)


def test_random_trees(bases):
    rng = random.Random(9)

    def tree(n):
        if n == 0:
            return Term(rng.choice("kls"), rng.choice([*OPS, "!="]), str(rng.choice([0, 1, 2, 5, 7, 10, 20])))
        kind = rng.choice([And, Or, Xor, Not])
        return Not(tree(n - 1)) if kind is Not else kind(tree(n - 1), tree(rng.randrange(n)))

    for _ in range(25):
        t, dialect = tree(3), rng.choice(["all", "any"])
        assert found(bases, t, dialect) == oracle(t, dialect), str(t)


def test_laws(bases):
    a, b = parse("k >= 5"), parse("s = 1")
    assert found(bases, Not(And(a, b))) == found(bases, Or(Not(a), Not(b)))
    assert found(bases, Xor(a, b)) == found(bases, Or(And(a, Not(b)), And(b, Not(a))))
    assert found(bases, parse("k < 10")) == found(bases, Not(parse("k >= 10")))


def test_unknown_names(bases):
    with pytest.raises(KeyError):
        found(bases, parse("nothing = 1"))
    with pytest.raises(KeyError):
        found(bases, parse("other.k = 1"))


def test_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2, 3), (2, 3, 4)], "id long, a int, b int").write.parquet(path)
    base = Base("b", spark.read.parquet(path), "id", {"a": ("a", "int32"), "b": ("b", "int32")})
    plan = Compiler({"b": base}).query("a = 2 & b > 1", "b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,2)" in plan and "GreaterThan(b,1)" in plan


def test_one_aggregation_for_many_terms(bases):
    plan = Compiler(bases).query("k = 5 & (k > 9 | l = 24)", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_other_docbase(spark):
    a = Base("a", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, ref string"), "id", {"ref": ("ref", "string")})
    rows = spark.createDataFrame([(1, "x"), (1, "z"), (2, "q")], "doc long, ref string")
    b = Base("b", spark.createDataFrame([(1, 5), (2, 6)], "id long, n int"), "id", {"n": ("n", "int32")}, {"ref": Postings(rows, "doc", "ref", "string")})
    c = Compiler({"a": a, "b": b})
    ids = lambda t: {r.docid for r in c.query(t, "a").collect()}
    assert ids("b.n = 5") == {1, 3} and ids("b.n = 6") == set()
    assert ids("ref = x & b.n = 5") == {1} and ids("ref = y | b.n = 5") == {1, 2, 3} and ids("ref = x ^ b.n = 5") == {3}


@pytest.fixture(scope="module")
def linked(spark):
    """A docbase and another one with three keys of it for each document, some of them strange."""
    rng = random.Random(4)
    a = spark.createDataFrame([(d, d % 4, d % 3) for d in range(1, 13)], "id long, ref int, s int")
    rows = [(d, rng.randrange(6)) for d in range(1, 9) for _ in range(2)]
    b = spark.createDataFrame([(d, d % 5) for d in range(1, 9)], "id long, n int")
    refs = spark.createDataFrame(rows, "doc long, ref int")
    bases = {"a": Base("a", a, "id", {"ref": ("ref", "int32"), "s": ("s", "int32")}), "b": Base("b", b, "id", {"n": ("n", "int32")}, {"ref": Postings(refs, "doc", "ref", "int32")})}
    return bases, {d: (d % 4, d % 3) for d in range(1, 13)}, {d: (d % 5, {r for x, r in rows if x == d}) for d in range(1, 9)}


def linked_oracle(node, a, b):
    if all(t.base == "b" for t in node.terms()) and not isinstance(node, Not):
        def holds(n, d):
            if isinstance(n, Term):
                v, c = b[d][0], int(n.value)
                return v != c if n.op == "!=" else OPS[n.op](v, c)
            if isinstance(n, Not):
                return not holds(n.child, d)
            x, y = holds(n.left, d), holds(n.right, d)
            return x and y if isinstance(n, And) else x or y if isinstance(n, Or) else x != y

        refs = {r for d in b if holds(node, d) for r in b[d][1]}
        return {d for d in a if a[d][0] in refs}
    if isinstance(node, Term):
        v = {d: a[d][0 if node.index == "ref" else 1] for d in a}
        return {d for d in a if (v[d] != int(node.value) if node.op == "!=" else OPS[node.op](v[d], int(node.value)))}
    if isinstance(node, Not):
        return set(a) - linked_oracle(node.child, a, b)
    x, y = linked_oracle(node.left, a, b), linked_oracle(node.right, a, b)
    return x & y if isinstance(node, And) else x | y if isinstance(node, Or) else x ^ y


def test_negation_across_docbases_is_a_complement(linked):
    bases, a, b = linked
    rng = random.Random(11)

    def tree(n):
        if n == 0:
            own = rng.random() < 0.5
            return Term(rng.choice(["ref", "s"]) if own else "n", rng.choice([*OPS, "!="]), str(rng.randrange(5)), None if own else "b")
        kind = rng.choice([And, Or, Xor, Not])
        return Not(tree(n - 1)) if kind is Not else kind(tree(n - 1), tree(rng.randrange(n)))

    for _ in range(8):
        t = tree(3)
        ids = [{r.docid for r in Compiler(bases).query(q, "a").collect()} for q in (t, Not(t))]
        assert ids[0] == linked_oracle(t, a, b), str(t)
        assert not ids[0] & ids[1] and ids[0] | ids[1] == set(a), str(t)


def test_no_query(bases):
    with pytest.raises(ValueError):
        Compiler(bases).query(Not(Pair(parse("k = 1"), parse("k = 2"))), "b")


def test_strays(spark, bases):
    table = spark.createDataFrame([(1,)], "id long")
    keys = spark.createDataFrame([(1, 5), (2, 5)], "doc long, k long")
    open_ = Base("b", table, "id", {}, {"k": Postings(keys, "doc", "k", "int64")}, closed=False)
    for q in ("k = 5", "k = 5 | k != 5", "k = 5 & k < 9", "k = 5 ^ k = 7"):
        assert found({"b": open_}, parse(q)) == {1}, q
    assert [tuple(r) for r in open_.strays().collect()] == [("k", 2)]
    assert bases["b"].strays().count() == 0
    cells = bases["b"].cell("k", spark.createDataFrame([(1,), (4,), (4,)], "docid long")).collect()
    assert sorted(map(tuple, cells), key=repr) == [(1, None), (4, 10), (4, 5)]
