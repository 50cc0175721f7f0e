"""Fill-in-middle against plain code."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import entries, fim
from tests import oracle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, seed=42, rate=50, suffix_first=80):
    text, key = text or "", "" if key is None else str(key)
    units, digest = UNITS.findall(text), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


HARD = ["", " ", "a", " a ", "a\x1eb \x1b c\x1e1 \x1b0\x1b1\x1e\x1e", "\x1e", "\x1b", "\x1b1", "<P>x y", "x <S", "<S <M> y", "x < P> y z", "ä ß x y 𝒳𝒴 😀 z", "\t\n\x0b\x0c\r", "a\x00b c", "$0 $1 \\ \\$", " \n  tail  \n ", "<P", "a <S b> <M c <P"]


def rows_of(spark, rows, **settings_):
    df = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), **settings_)
    return [tuple(r) for r in df.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()]


def test_hard_texts(spark):
    rows = [(k * 100 + i, t) for k in range(8) for i, t in enumerate([*HARD, None])]
    for rate in (50, 100):
        got = rows_of(spark, rows, rate=rate)
        assert sorted(got, key=lambda r: r[0]) == [(i, t, *plain(i, t, rate=rate), t or "") for i, t in rows]
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \t\nab<PSM>\x1e\x1b01é")), max_size=60), min_size=30, max_size=30))
def test_any_text(spark, texts):
    rows = list(enumerate(texts))
    assert sorted(rows_of(spark, rows, rate=90)) == [(i, t, *plain(i, t, rate=90), t) for i, t in rows]


def test_very_long_texts(spark):
    rows = [(i, t) for i in range(4) for t in ("x " * 400_000, "\n" * 2_000_000, "y" * 2_000_000, "\x1e" * 300_000)]
    got = sorted(rows_of(spark, rows, rate=100))
    assert got == sorted((i, t, *plain(i, t, rate=100), t) for i, t in rows)


def test_columns_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 1), (3, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("_lf_a", F.lit(7)).withColumn("odd.name", F.lit(8)).withColumn("Form", F.lit("x"))
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "_lf_a", "odd.name", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.collect()
    assert len(got) == 3 and sum(r["output"] == plain(None, "a b c")[4] for r in got) == 2
    assert [(r["n"], r["form"], r["output"]) for r in got if r["doc_id"] == 3] == [(0, "plain", "")]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="named"):
        fim.fill_in_middle(docs, text="n")


def test_query_stays_in_the_jvm_without_a_shuffle(spark, sf_dir):
    df = entries.op11_fill_in_middle(spark, sf_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "hashpartitioning" not in text
    got = {r["doc_id"]: r for r in df.collect()}
    for r in oracle.connect(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall():
        n, form, p, m, out = plain(*r)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[r[0]]) == (r[0], n, form, p, m, sha(out), sha(r[1] or ""))
