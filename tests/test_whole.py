"""Queries over whole tables and whole texts, each against a loop over small tables."""

import re


def write(df, sf_dir, name):
    df.write.parquet(f"{sf_dir}/{name}.parquet")


def test_ngram_repeat_block_reads_whole_texts(spark, tmp_path):
    from lexforge.plans import numeric

    own = " ".join(f"w{i}" for i in range(300))
    texts = ["a b a", "a b the the", f"{own} last last", f"{own} the the", own, "", "one", f"w299 {own}"]
    write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    got = {r.doc_id: r.blocked for r in numeric.ngram_repeat_block(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        tokens = [t for t in text.split(" ") if t != "the"]
        assert got[i] == (len(tokens) > len(set(tokens))), text[-20:]


def test_multiset_intersection_takes_whole_texts_and_all_items(spark, tmp_path):
    from collections import Counter

    from lexforge.plans import joining

    far = "Z" * 50 + " x" * 300
    texts = ["a b b c", f"{far} b b a", "Q 7", "", f"d {far} d d", f"{'long' * 120} e"]
    items = [(0, "a b"), (1, "b b b d d"), (2, f"{far} e"), (3, "none")]
    write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    write(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    got = {(r.doc_id, r.item_id): r.shared for r in joining.multiset_intersection(spark, str(tmp_path)).collect()}
    bag = lambda t: Counter(re.findall("[a-z]+", t))
    want = {(i, k): sum((bag(t) & bag(x)).values()) for i, t in enumerate(texts) for k, x in items}
    assert got == {k: n for k, n in want.items() if n}


def test_interval_token_join_makes_places_to_the_end(spark, tmp_path):
    from lexforge.plans import joining

    texts = ["", "a", "x" * 50, "x" * 51, "\n".join(f"line {i} of a long text" for i in range(1500))]
    write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    got = {(r.doc_id, r.begin): r.span_no for r in joining.interval_token_join(spark, str(tmp_path)).collect()}
    assert len(texts[-1]) > 25_000
    # A place lies in the line that ends with the next line end.
    assert got == {(i, b): t.count("\n", 0, b) for i, t in enumerate(texts) for b in range(0, len(t), 50)}


def test_dependency_closure_takes_all_customers(spark, tmp_path):
    from lexforge.plans import joining

    rows = [(1, 0), (2, 1), (3, 2), (10, 9), (28, 20)]
    write(spark.createDataFrame(rows, "c_custkey long, c_nationkey int"), tmp_path, "customer")
    got = {(r.a, r.b) for r in joining.dependency_closure(spark, str(tmp_path)).collect()}
    # 0 -> 1 -> 2 -> 3, 9 -> 10, and 20 -> 3: only the last one has a key divisible by 7.
    assert got == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (9, 10), (20, 3)}


def test_dot_score_topk_takes_all_queries_in_blocks(spark, tmp_path, monkeypatch):
    from lexforge.plans import numeric

    rows = [(i, [float((i * 37 + k * k * 11) % 19 - 9) for k in range(64)]) for i in range(0, 320, 2)]
    write(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tmp_path, "embeddings")
    monkeypatch.setattr(numeric, "BROADCAST_ROWS", 2, raising=False)
    got = sorted((r.q, r.vec_id, r.score) for r in numeric.dot_score_topk(spark, str(tmp_path)).collect())
    want = []
    for q, a in rows:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows)
            want += [(q, i, -s) for s, i in scores[:5]]
    assert got == sorted(want) and len({q for q, *_ in got}) == 7


def test_hypothesis_back_trace_takes_all_lines(spark, tmp_path):
    from lexforge.plans import decoding

    rows = [(1 + o, n, o * 5 + n * 3, o + 2 * n, float(10 * n + o % 7)) for o in range(120) for n in range(1, 8) if n <= 3 + o % 5]
    write(spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"), tmp_path, "lineitem")
    got = sorted((r.example, r.tokens) for r in decoding.hypothesis_back_trace(spark, str(tmp_path)).collect())
    slots = {}
    for order, step, part, supp, quantity in rows:
        back, token = slots.get((order % 50, step, part % 4), (9, 10**9))
        slots[order % 50, step, part % 4] = (min(back, supp % 4), min(token, int(quantity)))
    last = {}
    for example, step, _ in slots:
        last[example] = max(last.get(example, 0), step)
    want = []
    for example, step, slot in slots:
        if step == last[example]:
            tokens = []
            while (example, step, slot) in slots:
                slot, token = slots[example, step, slot]
                tokens.insert(0, str(token))
                step -= 1
            want.append((example, " ".join(tokens)))
    assert got == sorted(want) and max(last.values()) == 7


def test_tasks_of_joins_do_not_grow_with_their_rows(spark, sf_dir, monkeypatch):
    from lexforge.operators import joins
    from lexforge.plans import joining

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(joining, "DOCUMENTS", 10)
    assert "RepartitionByExpression [doc_id" in plan(joining.multiset_intersection(spark, sf_dir)) and f", {-(-docs.count() // 10)}" in plan(joining.multiset_intersection(spark, sf_dir))
    monkeypatch.setattr(joins, "POINTS", 100)
    points = docs.selectExpr("sum(ceil(length(text) / 50))").first()[0]
    assert plan(joining.interval_token_join(spark, sf_dir)).count(f", {-(-points // 100)}\n") >= 3
