"""Query trees, their text form and key parsing."""

import random

import pytest

from foliant.functions.keys import REGISTRY, key_type, parse_key
from foliant.plans.catalog import Catalog, load_catalog
from foliant.plans.parser import ParseError, parse
from foliant.plans.tree import And, Not, Or, Term, Xor, count_terms, rewrite


def test_right_associative_and_groups():
    a, b, c = Term("a", "=", "1"), Term("b", "=", "2"), Term("c", "=", "3")
    assert parse("a=1 & b=2 | c=3") == And(a, Or(b, c))
    assert parse("(a=1 & b=2) | c=3") == Or(And(a, b), c)
    assert parse("(a=1) ^ (b=2)") == Xor(a, b)
    assert parse("a=1 & (b=2 | c=3)") == And(a, Or(b, c))
    assert parse("((a=1))") == a
    assert parse("!a=1 & b=2") == And(Not(a), b)


def test_values_and_names():
    assert parse('x.y >= "a b\\"c"') == Term("y", ">=", 'a b"c', "x")
    assert parse("a < -1.5e3") == Term("a", "<", "-1.5e3")
    assert parse("a != 10abc") == Term("a", "!=", "10abc")


@pytest.mark.parametrize("text", ["a=", "=1", "a=1 &", "", "a=1)", "(a=1", "a 1", "a=1 b=2", "a=1 & & b=2"])
def test_failures(text):
    with pytest.raises(ParseError):
        parse(text)


def test_printing_round_trips():
    rng = random.Random(4)

    def tree(n):
        if n == 0:
            return Term(rng.choice("abc"), rng.choice(["=", "!=", "<", "<=", ">", ">="]), rng.choice(["1", "x y", 'q"q']))
        kind = rng.choice([And, Or, Xor, Not])
        return Not(tree(n - 1)) if kind is Not else kind(tree(n - 1), tree(rng.randrange(n)))

    for _ in range(50):
        t = tree(3)
        assert parse(str(t)) == t and count_terms(t) == sum(1 for _ in t.terms())


def test_rewrite():
    t = Term("a", "<", "1")
    assert rewrite(t) == Not(Term("a", ">=", "1"))
    assert rewrite(Not(Not(t))) == rewrite(t)
    assert rewrite(t, "any") == t
    assert rewrite(Not(And(t, t)), "any") == Or(Not(t), Not(t))
    with pytest.raises(ValueError):
        Term("a", "~", "1")


CASES = ["", "abc", "12abc", " -5", "+7", "300", "-129", "127", "128", "99999999999999999999999", "-99999999999999999999999", "18446744073709551615", "-1", "1.5abc", ".5", "1e3x", "-2.5e-1", "0012", "9223372036854775808"]


def test_columns_agree_with_literals(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    for name, t in REGISTRY.items():
        got = [r[0] for r in df.select(parse_key(df.s, name)).collect()]
        assert got == [t.literal(c) for c in CASES], name


LONG_CASES = [sign + digits + end for digits in ("0" * 40 + "7", "0" * 30, "9" * 18, "9" * 19, "1" + "0" * 20, "0" * 25 + "9" * 20, str(2**63), str(2**64), str(2**64 - 1)) for sign in ("", "-", " +") for end in ("", "x")] + ["+-5", "- 5", "\x015", "5\x01", "\n 5-LOW"]


def test_integers_are_parsed_by_few_searches(spark):
    df = spark.createDataFrame([(c,) for c in [*LONG_CASES, None]], "s string")
    for name in ("int8", "uint8", "int32", "uint32", "int64", "uint64"):
        out = df.select(parse_key(df.s, name).alias("k"))
        assert [r[0] for r in out.collect()] == [*map(key_type(name).literal, LONG_CASES), None], name
        # an expression is computed anew wherever it is named
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().replace("rlike", "regexp").count("regexp") < 12, name


def test_known_values():
    assert key_type("INT8").literal("300") == 44
    assert key_type("uint32").literal("-5") == 4294967291
    assert key_type("int32").literal("12abc") == 12
    assert key_type("char8").literal("abcdefghij") == "abcdefgh"
    with pytest.raises(ValueError):
        key_type("int128")


def test_strict(spark):
    df = spark.createDataFrame([("12",), ("12abc",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_key(df.s, "int32", "strict")).collect()] == [12, None, None, None]


def test_catalog():
    text = """<c><documents name="recipes" dir="/d/recipes" format="xml" capacity="50"><indexes directory="/i">
      <index name="recipe_id" type="string"><key>/recipe/id</key></index><index name="x" type="int8"/></indexes></documents>
      <documents name="reviews" dir="/d/reviews"><indexes><index name="recipe_id" type="string" unique="yes"><key>//r</key></index></indexes></documents></c>"""
    c = load_catalog(text)
    assert c.by_name("recipes").capacity == 50 and list(c.by_name("recipes").indexes) == ["recipe_id"]
    assert c.links() == {"recipe_id": ["recipes", "reviews"]} and c.by_name("reviews").index("recipe_id").unique
    assert c.route(["/d/recipes/a.xml", "/d/reviews/b.xml", "/d/recipes/c.xml"]) == {"recipes": ["/d/recipes/a.xml", "/d/recipes/c.xml"], "reviews": ["/d/reviews/b.xml"]}
    for f in (lambda: c.by_name("no"), lambda: c.route(["/no/a.xml"]), lambda: c.by_name("recipes").index("no")):
        with pytest.raises(KeyError):
            f()
    with pytest.raises(ValueError):
        c.route(["a.xml"])
    with pytest.raises(ValueError):
        load_catalog(text.replace('type="string"', 'type="text"'))
    assert Catalog().links() == {}
