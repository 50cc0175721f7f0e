"""SimHash against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexforge.llm import entries, simhash
from tests import oracle


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    """The index of the first value that links of three bits connect with each."""
    of, u = list(range(len(values))), np.array(values, np.uint64)

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(u ^ u[i]) <= 3)[0].tolist():
            a, b = find(i), find(j)
            of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def check(spark, rows, **settings):
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect())
    prints = [plain_print(t) for _, t in rows]
    root = roots(prints)
    least = {r: min(i for (i, _), x in zip(rows, root, strict=True) if x == r) for r in set(root)}
    assert got == sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True))
    return got


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "two Words", "A b C", "a b c d e A B C", "x" * 100, "é À ß ß x", "a\x1cb c\x85d e f", "word " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_very_long_texts(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "Gamma", "delta", "eps"], k=20_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def test_the_code_is_perfect():
    every = np.arange(1 << 23)
    index = simhash.decoded(every)
    assert (np.bincount(index, minlength=4096) == 2048).all()
    words = np.array([w for w in range(0, 1 << 23, 4099)])
    row, _ = simhash.indices(words)
    assert set(np.bincount(row).tolist()) <= {1, 6}


def test_two_errors_share_an_index():
    words = np.random.default_rng(1).integers(0, 1 << 23, 50)
    for w in words.tolist():
        own = set(simhash.indices(np.array([w]))[1].tolist())
        near = np.array([w ^ (1 << a | 1 << b) for a, b in itertools.combinations_with_replacement(range(23), 2)])
        row, index = simhash.indices(near)
        assert set(row[np.isin(index, list(own))].tolist()) == set(range(len(near)))


def test_three_errors_share_a_key():
    rng = np.random.default_rng(2)
    patterns = np.array([1 << a | 1 << b | 1 << c for a, b, c in itertools.combinations(range(64), 3)], np.uint64)
    for f in rng.integers(0, 1 << 63, 3).astype(np.uint64) * np.uint64(2) + np.uint64(1):
        own = simhash.keys(np.array([f], np.uint64))[1]
        row, key = simhash.keys(patterns ^ f)
        assert len(set(row[np.isin(key, own)].tolist())) == len(patterns)


def near_copies(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(6)]
    rows = [(i, near_copies(rng, rng.choice(bases), rng.randrange(4))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "  "), (403, "One two"), (404, "one TWO"), (405, bases[0].upper()), (405, bases[0]), (500, "é")]
    got = check(spark, rows)
    assert len({c for *_, c in got}) < 200


def prints_frame(spark, values):
    return spark.createDataFrame([(int(v),) for v in np.array(sorted(values), np.uint64).view(np.int64)], "f long")


@pytest.mark.parametrize("many", [1, 8, 128])
def test_crowded_keys_are_split_without_losing_links(spark, many):
    rng = random.Random(6)
    base, weak, values = rng.getrandbits(64), rng.sample(range(64), 9), set()
    for _ in range(300):
        values.add(base ^ sum(1 << b for b in weak if rng.random() < 0.5))
    for _ in range(30):
        other = base ^ sum(1 << b for b in rng.sample(range(64), 8))
        values |= {other, other ^ (1 << 40 | 1 << 20 | 1), other ^ 7}
    values = sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v)
    found = {r["node"]: r["label"] for r in simhash.components(simhash.edges_of(prints_frame(spark, values), many)).collect()}
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    assert [found.get(f, f) for f in signed] == [signed[r] for r in roots(values)]


def test_columns_and_nothing(spark):
    docs = spark.createDataFrame([(2, "a b c d", 1), (1, "A B  c d", 2), (None, "a b c d", 3), (None, None, 4)], "doc_id long, text string, f int").withColumn("component_id", F.lit("x")).withColumn("odd.name", F.lit(1))
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    p = f"{plain_print('a b c d'):016x}"
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2, p, 1), (1, p, 1), (None, p, 1), (None, "0" * 16, None)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entries.op13_simhash(spark, sf_dir).collect()}
    rows = oracle.connect(sf_dir).sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    prints = [plain_print(t) for _, t in rows]
    assert got == {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots(prints), strict=True)}
