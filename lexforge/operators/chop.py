"""Rewriting levels of syntax and kernel trees.

A level is a list of rules; the first rule that fits a list decides. A rule
either puts one part of the list in its place, or keeps a selection of its
parts, possibly under a marked tag. Whatever is left of a list is then closed
up: empty lists go, a single child takes its list's place.
"""

from __future__ import annotations

from collections.abc import Callable

from lexforge.operators.trees import Tree, apply_template, cut_depth, prune

# Tags of the tree formats.
REFERENCES = ["Id", "ConstRef", "Name", "GVar"]
PATHS = ["MPdot", "DirPath", "Constant", "MutInd", "MPfile"]
KERNEL_TAGS = ["GEvar", "GPatVar", "GApp", "GLambda", "GLetIn", "GCases", "GLetTuple", "GIf", "GRec", "GSort", "GHole", "GCast", "GInt"]
SYNTAX_TAGS = ["CRef", "CFix", "CCoFix", "CProdN", "CLambdaN", "CLetIn", "CAppExpl", "CApp", "CRecord", "CCases", "CLetTuple", "CIf", "CHole", "CPatVar", "CEvar", "CSort", "CCast", "CNotation", "CGeneralization", "CPrim", "CDelimiters", "CLocal"]
KERNEL_SHARE, SYNTAX_SHARE = 0.085, 0.092

#: What a rule makes of a list: None if it does not fit, ("in", part) or ("of", parts).
Rule = Callable[[list], tuple[str, object] | None]


def _tag(x: list) -> str | None:
    return x[0] if x and isinstance(x[0], str) else None


def _filled(x: Tree) -> bool:
    return isinstance(x, list) and len(x) > 0


def located(any_place: bool) -> Rule:
    """``((v X) (loc P))`` is X; without ``any_place`` only if P is empty."""
    def rule(x):
        fits = len(x) == 2 and all(isinstance(c, list) and len(c) == 2 for c in x) and x[0][0] == "v" and x[1][0] == "loc" and isinstance(x[1][1], list)
        return ("in", x[0][1]) if fits and (any_place or not x[1][1]) else None

    return rule


def unwrapped(tags: list[str]) -> Rule:
    return lambda x: ("in", x[1]) if len(x) == 2 and _tag(x) in tags else None


def last_of_path(tags: list[str]) -> Rule:
    """``(A (Xs) Ys)`` is the last of Ys, ``(A (Xs))`` the last of Xs."""
    def rule(x):
        if _tag(x) not in tags or len(x) < 2 or not _filled(x[1]):
            return None
        return ("in", x[-1] if len(x) > 2 else x[1][-1])

    return rule


def bare_reference(tag: str) -> Rule:
    return lambda x: ("in", x[1]) if len(x) == 3 and _tag(x) == tag and x[2] == [] else None


def indexed(x: list) -> tuple[str, object] | None:
    """The last path part of an inductive or constructor reference."""
    inner = x[1] if len(x) == 2 else None
    for tag, depth in (("IndRef", 1), ("ConstructRef", 2)):
        if _tag(x) == tag:
            for _ in range(depth):
                inner = inner[0] if isinstance(inner, list) and len(inner) == 2 else None
            return ("in", inner[-1]) if _filled(inner) else None
    return None


def product(x: list) -> tuple[str, object] | None:
    return ("of", ["<GProd>", x[1], *x[3:]]) if _tag(x) == "GProd" and len(x) >= 3 else None


def marked(tags: list[str]) -> Rule:
    return lambda x: ("of", [f"<{x[0]}>", *x[1:]]) if _tag(x) in tags else None


def _without(tags: list[str], *gone: str) -> list[str]:
    return [t for t in tags if t not in gone]


#: Rules of each level, in order. The x levels leave constants and indexed references as they are.
LEVELS: dict[str, list[Rule]] = {
    "kernel": [located(False), unwrapped(REFERENCES), last_of_path(PATHS), bare_reference("GRef"), indexed, product, marked(KERNEL_TAGS)],
    "kernel-x": [located(False), unwrapped(_without(REFERENCES, "ConstRef")), last_of_path(_without(PATHS, "Constant")), bare_reference("GRef"), product, marked(KERNEL_TAGS)],
    "syntax": [located(True), unwrapped(_without(REFERENCES, "GVar")), last_of_path(PATHS), bare_reference("CRef"), indexed, marked(SYNTAX_TAGS)],
    "syntax-x": [located(True), unwrapped(_without(REFERENCES, "GVar", "ConstRef")), last_of_path(_without(PATHS, "Constant")), bare_reference("CRef"), marked(SYNTAX_TAGS)],
}


def rewrite(tree: Tree, rules: list[Rule], close_up: bool = True) -> Tree | None:
    """Top-down by the rules, closed up bottom-up (or with every list as it comes); without recursion."""
    def ruled(x: Tree) -> Tree:
        """A leaf, or the parts that a list is left with."""
        while isinstance(x, list):
            for rule in rules:
                said = rule(x)
                if said is not None:
                    break
            else:
                return x
            if said[0] == "of":
                return said[1]
            x = said[1]
        return x

    # The lists that are open: what is left of each, and what has been made of it. A marked tag is a leaf and is not looked at again.
    results: list[list] = [[]]
    todo = [iter([tree])]
    while todo:
        for c in todo[-1]:
            if not isinstance(c, str):
                c = ruled(c)
            if not isinstance(c, str):
                results.append([])
                todo.append(iter(c))
                break
            results[-1].append(c)
        else:
            todo.pop()
            if todo:
                kept = results.pop()
                if len(kept) == 1 and close_up:
                    results[-1].append(kept[0])
                elif kept or not close_up:
                    results[-1].append(kept)
    return results[0][0] if results[0] else None


def without_header(tree: Tree) -> Tree | None:
    """A statement's syntax without its command, kind and name."""
    if not (isinstance(tree, list) and len(tree) == 3 and tree[0] == "VernacExpr" and _filled(tree[2]) and len(tree[2]) >= 3):
        raise ValueError("not a statement")
    outer = tree[2][2]
    if not (_filled(outer) and _filled(outer[0]) and _filled(outer[0][0])):
        raise ValueError("not a statement")
    rest = lambda x: ["K"] * (len(x) - 1)
    innermost = ["R", *rest(outer[0][0])]
    return apply_template(tree, ["R", "R", ["R", "R", [[innermost, *rest(outer[0])], *rest(outer)], *["K"] * (len(tree[2]) - 3)]])


def without_products(tree: Tree) -> Tree:
    """The last child instead of each leading product."""
    while isinstance(tree, list) and len(tree) >= 2 and tree[0] == "<GProd>":
        tree = tree[-1]
    return tree


def level(tree: Tree, name: str, seed: str = "") -> Tree | None:
    """One named level of a raw tree; later levels of a kind build on the earlier ones."""
    if name == "whole":
        return tree
    if name in LEVELS:
        return rewrite(tree, LEVELS[name])
    if name == "kernel-2":
        first = rewrite(tree, LEVELS["kernel"])
        return None if first is None else without_products(first)
    if name == "syntax-0":
        return without_header(tree)
    if name == "syntax-1":
        bare = without_header(tree)
        return None if bare is None else rewrite(bare, LEVELS["syntax"])
    if name == "depth-10":
        return cut_depth(tree, 10)
    if name in ("kernel-random", "syntax-random"):
        return prune(tree, KERNEL_SHARE if name[0] == "k" else SYNTAX_SHARE, seed)
    raise KeyError(name)


def unmarked_product(x: list) -> tuple[str, object] | None:
    return ("of", ["GProd", x[1], *x[3:]]) if _tag(x) == "GProd" and len(x) >= 3 else None


def reduced(tree: Tree) -> Tree:
    """A kernel tree with wrappers, paths and references reduced until none is left; tags stay unmarked, lists as they are."""
    return rewrite(tree, [*LEVELS["kernel"][:5], unmarked_product], close_up=False)


def conclusion(tree: Tree) -> Tree:
    """What stands after the last of the leading products of a raw tree."""
    while isinstance(tree, list) and len(tree) >= 2 and tree[0] == "GProd":
        tree = tree[-1]
    return tree
