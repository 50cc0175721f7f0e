"""Names of many documents split at once, against the rule for one document."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lexforge.operators import subtokens as S

STEMS = ["ab", "add", "addr", "addrs", "addresses", "is", "iso", "isomorph", "sub", "subs", "subst", "xyz", "nat", "order", "orders", "x", "le", "ler", "ene", "ssreflect"]
OTHERS = ["Sub", "XY", "addrPoint", "order_l", "iso__Pn", "été", "éTat", "", "not ok", "a1", "K"]


def made(rng, docs=12):
    """Documents (key, names, modules), and rows of a corpus as both sides take them."""
    word = lambda: "".join(rng.choice(STEMS) for _ in range(rng.randrange(1, 4)))
    said = [word() for _ in range(30)]
    held = [(k, [rng.choice([*said, *(s.capitalize() for s in said[:9]), *OTHERS]) for _ in range(rng.randrange(25))], rng.sample(["Iso", "m", "subst", "nat", "Addr"], rng.randrange(3))) for k in range(docs)]
    parts = sorted({w[i:j].lower() for w in [*said, *OTHERS, *STEMS] for i in range(2) for j in range(i + 2, len(w) + 1)})
    rows = {}
    for place, w in enumerate(rng.sample(parts, len(parts) * 2 // 3)):
        known, x = rng.random() < 0.6, round(rng.choice([1, 3, 3.6, 10]) * rng.choice([1, 1 / 3, 2.2]), S.DECIMALS)
        rows[w] = (known, place if known else None, x, math.inf if known and w in S.ATOMIC_WORDS else x + rng.randrange(3))
    return held, rows


def as_corpus(rows):
    known, place, visit, weight = zip(*rows.values(), strict=True)
    return S._Corpus(pa.table({"word": pa.array(list(rows), pa.string()), "known": pa.array(known, pa.bool_()), "place": pa.array(place, pa.int64()), "visit": pa.array(visit, pa.float64()), "weight": pa.array(weight, pa.float64())}))


def as_docs(held):
    keys, names, modules = zip(*held, strict=True)
    return pa.table({"doc": pa.array(keys, pa.int64()), "names": pa.array(names, pa.list_(pa.string())), "modules": pa.array(modules, pa.list_(pa.string()))})


def split(held, rows):
    out = {}
    for b in S._split_block(as_docs(held), as_corpus(rows)):
        for r in b.to_pylist():
            out.setdefault(r["doc"], []).append((r["n"], r["name"], r["pieces"]))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_a_block_against_the_rule(seed, monkeypatch):
    monkeypatch.setattr(S, "TOGETHER", 40)
    held, rows = made(random.Random(seed))
    got = split(held, rows)
    for key, names, modules in held:
        context = S.CorpusContext(rows, names, modules)
        assert got.get(key, []) == [(k, n, S.split_name(n, context)) for k, n in enumerate(names)]


@pytest.mark.parametrize("seed", range(12))
def test_weights_of_many_documents_are_those_of_each(seed):
    held, rows = made(random.Random(seed))
    coded = pa.array([n for _, names, _ in held for n in names], pa.string()).dictionary_encode()
    modules = pa.array([m.lower() for _, _, ms in held for m in ms], pa.string())
    block = S._Block(coded.dictionary, set(modules.to_pylist()), as_corpus(rows))
    number = np.arange(len(held))
    found = block.weights(np.repeat(number, [len(n) for _, n, _ in held]), coded.indices.to_numpy().astype(np.int64), np.repeat(number, [len(m) for _, _, m in held]), block.number(modules))
    for k, (_, names, ms) in enumerate(held):
        mine, want = S._Context(block, found, k), S.CorpusContext(rows, names, ms)
        assert {w: x for w, x in mine._changed.items() if w not in S.ATOMIC_WORDS} == {w: x for w, x in want._changed.items() if w not in S.ATOMIC_WORDS}
        assert all(mine.get(w) == want.get(w) for w in [*rows, *want._changed, "none"])


def test_plain_names_are_not_looked_at_document_by_document(monkeypatch):
    def fail(*_):
        raise AssertionError("one document at a time")

    for x in ("CorpusContext", "_Context", "split_name", "_known_of"):
        monkeypatch.setattr(S, x, fail)
    rows = {"add": (True, 0, 9.0, 9.0), "ord": (True, 1, 3.0, 3.0)}
    got = split([(k, ["Order", "addr", "order", "x"], ["m"]) for k in range(500)], rows)
    assert len(got) == 500 and {str(x) for x in got.values()} == {str([(0, "Order", ["Order"]), (1, "addr", ["add", "r"]), (2, "order", ["order"]), (3, "x", ["x"])])}


@pytest.mark.parametrize("seed", range(6))
def test_a_block_needs_no_other_rows_than_those_listed(seed):
    held, rows = made(random.Random(seed), 4)
    words, own = S._listed(pa.array(sorted({n for _, names, _ in held for n in names}), pa.string()), {m.lower() for _, _, ms in held for m in ms}, S.needed)
    few = {w: rows[w] for w, mine in zip(words.to_pylist(), own.to_pylist(), strict=True) if w in rows and (rows[w][0] or mine)}
    assert len(words) == len(set(words.to_pylist())) and split(held, few) == split(held, rows)


def test_suffixes_of_many_names():
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("xgmnlrbfzetqak") for _ in range(rng.randrange(1, 9))) for _ in range(3000)})
    chains = S._Plain(pa.array(names))
    rest, inner, end = (x.to_pylist() for x in (chains.rest, chains.inner, chains.end))
    for k, n in enumerate(names):
        some, want = slice(chains.at[k], chains.at[k] + chains.most[k] + 1), S._chain(n)
        assert (rest[some], inner[some], end[some]) == (want.rests, want.inner, [*want.ends, None])
    assert chains.long.tolist() == [len(r) for r in rest] and len(S._Plain(pa.array([], pa.string())).rest) == 0


def test_numbers_are_rounded_as_python_does():
    rng = random.Random(5)
    x = [rng.random() * 10.0 ** rng.randrange(-3, 12) for _ in range(20_000)] + [k + 3 / 1024 for k in range(4000)] + [0.0, -2.5e-9, 3e6 + 1 / 3, 2.0**52 + 1, 1e200]
    assert S._rounded(np.array(x)).tolist() == [round(v, S.DECIMALS) for v in x]


def test_odd_rows_of_the_query(spark, tmp_path):
    from lexforge.plans import catalog, structure

    rows = [(1, "Adders add orders, lessened", "src"), (1, "orders, elements add", "m"), (None, "add restored", None), (None, "adders", "src"), (2, None, "src"), (3, "", "src"), (4, "12 !", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["subtokenize_full"](spark, str(tmp_path)).collect()), key=str)
    names, definitions = structure._names_and_definitions(spark, str(tmp_path))
    for shipped in (0, S.SHIPPED):
        want = S.split_documents(names, definitions, "doc_id", "at", shipped).collect()
        assert got == sorted(((r["doc_id"], r["n"], "|".join(r["pieces"])) for r in want), key=str)
    # Words of two rows of a document both count.
    assert len(got) == 4 + 3 + 2 + 1
