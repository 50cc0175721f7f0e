"""Parenthesised trees as node arrays.

A tree is an array of nodes in pre-order: (depth, leaf, text); depth is 1 at the
root, a list's text is null. Spark has no recursive type, but with pre-order
and depth every structural question is one about neighbours or ranges of the
array. Parsing and rewriting run in Arrow batches with an explicit stack, so
depth is bounded by memory, not by recursion. Measures of well-formed text
without quoted parentheses have built-in expressions beside them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tree in memory: a leaf is a string, a list is a list.
Tree = str | list

NODE = "array<struct<depth:int,leaf:boolean,text:string>>"


class MalformedTree(ValueError):
    pass


#: A parenthesis, a quoted leaf (to the end of the text if no quote ends it), or an atom.
_LEXEME = re.compile(r'[()]|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[^\s()"]+', re.S)
_QUOTED = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def parse_all(text: str) -> list[Tree]:
    """All trees of a text, one after the other."""
    found = _parse_plain(text)
    return _parse_lexemes(text) if found is None else found


def _parse_plain(text: str) -> list[Tree] | None:
    """``parse_all`` by splitting at blanks, which is faster than a pattern; None where quotes have escapes or something is malformed."""
    last = text[-1:]
    if not (last in (")", '"') or last.isspace()) or ('"' in text and "\\" in text):
        return None
    out: list[Tree] = []
    stack: list[list] = []
    push, pop = stack.append, stack.pop
    top, quoted = out, True
    for piece in text.split('"'):
        quoted = not quoted
        if quoted:
            top.append(piece)
            continue
        for x in piece.replace("(", " ( ").replace(")", " ) ").split():
            if x == "(":
                child: list = []
                top.append(child)
                push(top)
                top = child
            elif x != ")":
                top.append(x)
            elif stack:
                top = pop()
            else:
                return None
    return None if stack or quoted else out


def _parse_lexemes(text: str) -> list[Tree]:
    out: list[Tree] = []
    stack: list[list] = []
    push, pop = stack.append, stack.pop
    top, x = out, None
    for x in _LEXEME.findall(text):
        if x == "(":
            child: list = []
            top.append(child)
            push(top)
            top = child
        elif x == ")":
            if not stack:
                raise MalformedTree("a closing parenthesis without an opening one")
            top = pop()
        elif x[0] == '"':
            top.append(_ESCAPED.sub(r"\1", x[1:-1]) if "\\" in x else x[1:-1])
        else:
            top.append(x)
    if x and x[0] == '"' and not _QUOTED.fullmatch(x):
        raise MalformedTree("an open quote")
    if x and x[0] not in '()"' and not text[-1].isspace():
        raise MalformedTree("an atom at the end")
    if stack:
        raise MalformedTree("an open parenthesis")
    return out


def parse(text: str) -> Tree:
    found = parse_all(text)
    if len(found) != 1:
        raise MalformedTree(f"{len(found)} trees")
    return found[0]


def walk(tree: Tree) -> Iterator[tuple[int, Tree]]:
    """(depth, subtree) in pre-order."""
    todo = [(1, tree)]
    while todo:
        depth, x = todo.pop()
        yield depth, x
        if isinstance(x, list):
            todo.extend((depth + 1, c) for c in reversed(x))


def to_nodes(tree: Tree) -> list[dict]:
    return [{"depth": d, "leaf": isinstance(x, str), "text": x if isinstance(x, str) else None} for d, x in walk(tree)]


def from_nodes(nodes) -> Tree | None:
    root: list = []
    path: list[list] = [root]
    for x in nodes:
        del path[x["depth"] :]
        new = x["text"] if x["leaf"] else []
        path[-1].append(new)
        if not x["leaf"]:
            path.append(new)
    return root[0] if root else None


def _atom(text: str) -> str:
    if " " in text:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return text


def show(tree: Tree, spaced: bool = False) -> str:
    """Canonical text: a blank goes only before a leaf that has an earlier leaf beside it, or with ``spaced`` before every child but the first."""
    if isinstance(tree, str):
        return _atom(tree)
    out = ["("]
    # The lists that are open around this one: what is left of each, and whether its next leaf (child, if spaced) gets a blank.
    todo: list[tuple[Iterator[Tree], bool]] = []
    rest, blank = iter(tree), False
    while True:
        for c in rest:
            if isinstance(c, str):
                if " " in c:
                    c = _atom(c)
                out.append(" " + c if blank else c)
                blank = True
            else:
                out.append(" (" if blank and spaced else "(")
                todo.append((rest, blank or spaced))
                rest, blank = iter(c), False
                break
        else:
            out.append(")")
            if not todo:
                return "".join(out)
            rest, blank = todo.pop()


def pretty(tree: Tree, max_depth: int = 1 << 30, indent: int = 0) -> str:
    """One line for each list, indented by depth; what is deeper than ``max_depth`` becomes dots."""
    lines = []
    for depth, x in walk(tree):
        if depth <= max_depth:
            lines.append("  " * (indent + depth - 1) + (_atom(x) if isinstance(x, str) else "." * (depth == max_depth and bool(x)) or "()" if not x or depth == max_depth else "+"))
    return "\n".join(lines)


def height(tree: Tree) -> int:
    """0 for a leaf; an empty list has height 1."""
    return max((d for d, x in walk(tree) if isinstance(x, list)), default=0)


def dfs(tree: Tree, parentheses: bool = True, backwards: bool = False) -> list[str]:
    """Leaves in depth-first order, with a pair of parentheses around each list; backwards, children come last first."""
    out, todo = [], [("tree", tree)]
    while todo:
        kind, x = todo.pop()
        if kind == "text" or isinstance(x, str):
            out.append(x)
            continue
        inner = [("tree", c) for c in (reversed(x) if backwards else x)]
        todo.extend(reversed([("text", "("), *inner, ("text", ")")] if parentheses else inner))
    return out


def fold(tree: Tree, leaf: Callable[[str], object], node: Callable[[list, list], object]) -> object:
    """Bottom-up: ``leaf`` of each string, ``node`` of each list and its children's results."""
    done: list[list] = [[]]
    todo: list[tuple[Tree, bool]] = [(tree, False)]
    while todo:
        x, ready = todo.pop()
        if isinstance(x, str):
            done[-1].append(leaf(x))
        elif ready:
            children = done.pop()
            done[-1].append(node(x, children))
        else:
            done.append([])
            todo.append((x, True))
            todo.extend((c, False) for c in reversed(x))
    return done[0][0]


GONE = object()


def modify(tree: Tree, change: Callable[[Tree], object]) -> Tree | None:
    """``change`` of every subtree, bottom-up; what becomes ``GONE`` is left out of its list."""
    out = fold(tree, change, lambda _, kids: change([k for k in kids if k is not GONE]))
    return None if out is GONE else out


def collect(tree: Tree, wanted: Callable[[Tree], bool], stop: bool = False) -> list[Tree]:
    """Subtrees in pre-order that are wanted; with ``stop`` nothing inside a hit is looked at."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        hit = wanted(x)
        if hit:
            out.append(x)
        if isinstance(x, list) and not (hit and stop):
            todo.extend(reversed(x))
    return out


def apply_template(tree: Tree, template: Tree) -> Tree | None:
    """Keep (K), remove (R) or replace (U...) by a template of the same shape; empty lists go, single children take their list's place."""
    if isinstance(template, str):
        if template == "K":
            return tree
        if template == "R":
            return None
        if template.startswith("U") and isinstance(tree, str):
            return template[1:]
        raise ValueError("the template does not match the tree")
    if isinstance(tree, str) or len(tree) != len(template):
        raise ValueError("the template does not match the tree")
    kept = [k for k in map(apply_template, tree, template) if k is not None]
    return None if not kept else kept[0] if len(kept) == 1 else kept


def cut_depth(tree: Tree, deepest: int = 10) -> Tree:
    """Without the nodes deeper than ``deepest``; lists may become empty."""
    return from_nodes([n for n in to_nodes(tree) if n["depth"] <= deepest])


def prune(tree: Tree, keep: float, seed: str) -> Tree:
    """Each node but the root stays with probability ``keep``, drawn from a hash of the seed and its place; the children of a list that goes take its place."""
    if isinstance(tree, str):
        return tree
    # The seed is hashed once; a digest is below its bound where the number of its first eight bytes is below ``keep * 2**64``.
    seeded = hashlib.sha256(f"{seed}:".encode())
    bound = b"\xff" * 33 if keep >= 1 else math.ceil(max(keep, 0) * 2**64).to_bytes(8, "big")
    out: list = []
    todo: list[tuple[Iterator[Tree], list]] = []
    rest, into, place = iter(tree), out, 0
    while True:
        for x in rest:
            place += 1
            drawn = seeded.copy()
            drawn.update(b"%d" % place)
            kept = drawn.digest() < bound
            if isinstance(x, str):
                if kept:
                    into.append(x)
                continue
            todo.append((rest, into))
            if kept:
                new: list = []
                into.append(new)
                into = new
            rest = iter(x)
            break
        else:
            if not todo:
                return out
            rest, into = todo.pop()


# --- Spark surface --------------------------------------------------------------


def _text_function(f: Callable[[Tree], str | None]) -> Callable:
    def run(text: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                out = f(parse(x))
            except MalformedTree:
                return None
            return out

        return text.map(one)

    return F.pandas_udf(run, "string")


def rewritten(text: Column, change: Callable[[Tree], Tree | None]) -> Column:
    """The canonical text of each tree after ``change``; null where the text is not one tree or nothing remains."""
    return _text_function(lambda t: None if (out := change(t)) is None else show(out))(text)


def rewritten_all(text: Column, changes: dict[str, Callable[[Tree], Tree | None]]) -> Column:
    """A struct with ``rewritten`` by each change under its name, parsed once for all; a change must leave its tree as it is."""
    def run(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in changes]
        for x in texts.to_pylist():
            try:
                tree = None if x is None else parse(x)
            except MalformedTree:
                tree = None
            for found, change in zip(out, changes.values(), strict=True):
                found.append(None if tree is None or (new := change(tree)) is None else show(new))
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in out], list(changes))

    return F.arrow_udf(run, "struct<" + ",".join(f"`{n}`:string" for n in changes) + ">")(text)


def node_array(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        # The nodes of all texts one after the other: a dictionary for each would take longer than parsing.
        depths, words, ends, missing = [], [], [0], []
        for x in texts.to_pylist():
            try:
                tree = None if x is None else parse(x)
            except MalformedTree:
                tree = None
            missing.append(tree is None)
            for depth, node in walk(tree) if tree is not None else ():
                depths.append(depth)
                words.append(node if isinstance(node, str) else None)
            ends.append(len(depths))
        said = pa.array(words, pa.string())
        nodes = pa.StructArray.from_arrays([pa.array(depths, pa.int32()), said.is_valid(), said], ["depth", "leaf", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(run, NODE)(text)


def tree_list(text: Column) -> Column:
    """The canonical texts of all trees in a text."""
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else [show(t) for t in parse_all(x)]
            except MalformedTree:
                return None

        return s.map(one)

    return F.pandas_udf(run, "array<string>")(text)


def tokens_of(text: Column) -> Column:
    """Depth-first tokens with parentheses, of text without quoted parentheses."""
    return F.regexp_extract_all(text, F.lit(r"[()]|[^\s()]+"), F.lit(0))


def height_of(text: Column) -> Column:
    """Height of a list's text: the deepest nesting, counted by a running sum."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, t):
        now = s["now"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(tokens_of(text), start, step)["most"]


def leaf_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s()]+"))


def node_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s()]+|\("))


def has_leaf(text: Column, leaf: Column) -> Column:
    return F.array_contains(tokens_of(text), leaf)


def backwards_of(text: Column) -> Column:
    """Reverse depth-first tokens; the parentheses still open and close."""
    return F.transform(F.reverse(tokens_of(text)), lambda t: F.when(t == "(", ")").when(t == ")", "(").otherwise(t))


def edges_of(nodes: Column) -> Column:
    """(parent, child, text) rows of a node array: the parent is the last earlier node that is one less deep."""
    def run(s: pd.Series) -> pd.Series:
        def one(tree):
            if tree is None:
                return None
            last: dict[int, int] = {}
            out = []
            for i, x in enumerate(tree):
                out.append({"parent": last.get(x["depth"] - 1), "child": i, "text": x["text"]})
                last[x["depth"]] = i
            return out

        return s.map(one)

    return F.pandas_udf(run, "array<struct<parent:bigint,child:bigint,text:string>>")(nodes)
