"""Steps of trees that all rows take: parsing, printing, pruning and the texts that they start from."""

import hashlib
import random

import pytest

from lexforge.operators import syntax as S
from lexforge.operators import trees as T
from lexforge.plans import catalog


class Unused:
    def __getattr__(self, name):
        raise AssertionError(f"{name} of a pattern is used")


def test_plain_text_is_parsed_without_a_pattern(monkeypatch):
    monkeypatch.setattr(T, "_LEXEME", Unused())
    assert T.parse_all('(a (b\t"c (d" ())"e""") (f) ') == [["a", ["b", "c (d", []], "e", ""], ["f"]]
    assert T.parse_all(" \n") == [] and T.parse_all("a ") == ["a"]


def _outcome(parse, text):
    try:
        return parse(text)
    except T.MalformedTree as e:
        return str(e)


def test_both_ways_of_parsing_agree():
    rng, plain = random.Random(5), 0
    for _ in range(30_000):
        text = "".join(rng.choices(["(", ")", "a", "b ", " ", '"', '"("', "\\", "\n", " ", "\x00"], [4, 4, 2, 2, 1, 1, 1, 0.3, 0.3, 0.3, 0.3], k=rng.randrange(12)))
        text = f"({text})" if rng.random() < 0.5 else text
        assert _outcome(T.parse_all, text) == _outcome(T._parse_lexemes, text)
        plain += T._parse_plain(text) is not None
    assert plain > 3_000


def test_a_seed_is_hashed_once_for_all_nodes(monkeypatch):
    made, sha256 = [], hashlib.sha256
    monkeypatch.setattr(hashlib, "sha256", lambda x: made.append(x) or sha256(x))
    T.prune(T.parse("(a b (c d e) f (g (h i)))"), 0.5, "s")
    assert made == [b"s:"]


def _pruned(tree, keep, seed):
    """Pruning as it is defined, with a number for each node."""
    places = iter(range(10**9))

    def children(t):
        out = []
        for c in t:
            kept = int(hashlib.sha256(f"{seed}:{next(places)}".encode()).hexdigest()[:16], 16) < keep * 2**64
            below = c if isinstance(c, str) else children(c)
            out += [below] if kept else [] if isinstance(c, str) else below
        return out

    next(places)
    return tree if isinstance(tree, str) else children(tree)


@pytest.mark.parametrize("keep", [0.0, 1e-30, 0.25, 0.5, 0.9, 1.0])
def test_pruning_follows_its_definition(keep):
    rng = random.Random(6)

    def tree(depth):
        return "ab"[rng.randrange(2)] if depth > 4 or rng.random() < 0.4 else [tree(depth + 1) for _ in range(rng.randrange(5))]

    for i in range(2_000):
        t = tree(0)
        assert T.prune(t, keep, f"s{i}") == _pruned(t, keep, f"s{i}")


def test_blanks_of_both_forms():
    t = T.parse('(a (b) c ((d e) f "g h") () (() i))')
    assert T.show(t) == '(a(b) c((d e)f "g h")()(()i))'
    assert T.show(t, spaced=True) == '(a (b) c ((d e) f "g h") () (() i))'


def test_lexemes_of_other_shapes():
    place = "(loc (((fname (InFile f.v))(line_nb 1)(bol_pos 0)(line_nb_last 1)(bol_pos_last 0)(bp 3)(ep 4))))"
    one = S.lexeme(T.parse(f'((v (IDENT "abc")){place})'))
    assert one == S.Lexeme("abc", "ID", S.Place(3, 6, "f.v", 1))
    assert S.lexeme([["v", ["IDENT", "abc"], "more"], T.parse(place), "more"]) == one
    for bad in (f"(vx {place})", f"((w (IDENT a)){place})", "((v (IDENT a)))", f"((v){place})", "(x)", "()"):
        with pytest.raises(S.Mismatch):
            S.lexeme(T.parse(bad))


def test_texts_of_lexemes_need_no_format(spark, sf_dir):
    assert "format_string" not in catalog.queries()["lexeme_forms"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_a_canonical_tree_and_the_count_come_from_one_pass(spark, sf_dir):
    df = catalog.queries()["tree_canonical"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("run(") == 1
