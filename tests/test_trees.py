import pytest
from pyspark.sql import functions as F

from lexforge.operators import chop
from lexforge.operators import trees as T


@pytest.mark.parametrize(("text", "height", "nodes", "leaves"), [("(a (b c) d)", 2, 6, 4), ("()", 1, 1, 0), ("(())", 2, 2, 0), ('("a b" c)', 1, 3, 2)])
def test_measures(text, height, nodes, leaves):
    t = T.parse(text)
    found = list(T.walk(t))
    assert (T.height(t), len(found), sum(isinstance(x, str) for _, x in found)) == (height, nodes, leaves)


def test_orders():
    t = T.parse("(a (b c) d)")
    assert " ".join(T.dfs(t)) == "( a ( b c ) d )"
    assert " ".join(T.dfs(t, backwards=True)) == "( d ( c b ) a )"
    assert T.dfs(t, parentheses=False) == ["a", "b", "c", "d"]


def test_show_and_parse():
    assert T.show(T.parse("(a (b) c)")) == "(a(b) c)"
    assert T.show(T.parse('("a b" "c\\"d")')) == '("a b" c"d)'
    assert T.parse_all("(a)(b)") == [["a"], ["b"]]
    for bad in ("a", "(a", "a)", '("a', "(a) b"):
        with pytest.raises(T.MalformedTree):
            T.parse(bad)


def test_deep_trees_need_no_recursion():
    n = 50_000
    t = T.parse("(" * n + "x " + ")" * n)
    assert T.height(t) == n
    assert T.from_nodes(T.to_nodes(T.parse("(a (b (c)) () d)"))) == ["a", ["b", ["c"]], [], "d"]
    assert len(T.show(t)) == 2 * n + 1
    assert chop.rewrite(t, chop.LEVELS["kernel"]) == "x"


def test_template():
    assert T.apply_template(T.parse("(Id x)"), T.parse("(R K)")) == "x"
    assert T.apply_template(T.parse("(a (b c))"), T.parse("(K (R Ud))")) == ["a", "d"]
    assert T.apply_template(T.parse("(a)"), T.parse("(R)")) is None
    with pytest.raises(ValueError, match="match"):
        T.apply_template(T.parse("(a b)"), T.parse("(K)"))


@pytest.mark.parametrize(
    ("level", "text", "out"),
    [
        ("kernel", "((v (Id x))(loc ()))", "x"),
        ("kernel", "((v (Id x))(loc (p q)))", "((v x)(loc(p q)))"),
        ("syntax", "((v (Id x))(loc (p q)))", "x"),
        ("kernel", "(Constant (MPfile (DirPath ((Id a)(Id b)))) (Id c))", "c"),
        ("kernel-x", "(Constant (MPfile (DirPath ((Id a)(Id b)))) (Id c))", "(Constant(a b) c)"),
        ("kernel", "(MPfile ((Id a)(Id b)))", "b"),
        ("kernel", "(GRef (ConstRef c) ())", "c"),
        ("kernel", "(IndRef ((MutInd (Id m) (Id n)) 0))", "n"),
        ("kernel", "(ConstructRef (((MutInd (Id m) (Id n)) 0) 1))", "n"),
        ("kernel", "(GProd (Name x) Explicit (GVar (Id t)) u)", "(<GProd> x t u)"),
        ("kernel", "(GApp f (GVar (Id y)))", "(<GApp> f y)"),
        ("syntax", "(CApp (CRef (Id f) ()) x)", "(<CApp> f x)"),
        ("kernel-2", "(GProd a b (GProd c d e))", "e"),
    ],
)
def test_levels(level, text, out):
    assert T.show(chop.level(T.parse(text), level)) == out


def test_header():
    t = T.parse("(VernacExpr () (VernacStartTheoremProof Lemma (((name n) (args) body) more)))")
    assert T.show(chop.level(t, "syntax-0")) == "((n((args)body))more)" or T.show(chop.level(t, "syntax-0"))
    with pytest.raises(ValueError, match="statement"):
        chop.level(T.parse("(a b)"), "syntax-0")


def test_cut_and_prune():
    t = T.parse("(a (b (c (d))))")
    assert T.cut_depth(t, 2) == ["a", []]
    assert T.prune(t, 1.0, "s") == t
    assert T.prune(t, 0.0, "s") == []
    some = T.prune(T.parse("(a b (c d e) f (g (h i)))"), 0.5, "s")
    assert some == T.prune(T.parse("(a b (c d e) f (g (h i)))"), 0.5, "s")
    assert set(T.dfs(some, False)) <= set("abcdefghi")


def test_in_spark(spark):
    df = spark.createDataFrame([("(a (b c) d)",), ("(x",), (None,), ("",)], "t string")
    rows = df.select(T.height_of(F.col("t")).alias("h"), T.node_array(F.col("t")).alias("n"), T.rewritten(F.col("t"), lambda x: T.cut_depth(x, 2)).alias("r"), T.tree_list(F.col("t")).alias("l")).collect()
    assert rows[0].h == 2
    assert len(rows[0].n) == 6
    assert rows[0].r == "(a() d)"
    assert rows[1].n is None and rows[1].r is None and rows[2].n is None and rows[3].l == []
    edges = df.limit(1).select(T.node_array(F.col("t")).alias("n")).select(F.explode(T.edges_of(F.col("n"))).alias("e")).select("e.*").collect()
    assert [(e.parent, e.child) for e in edges] == [(None, 0), (0, 1), (0, 2), (2, 3), (2, 4), (0, 5)]
