import public_tokenizers as P

import corpus_pipeline
from lexforge.llm import jaccard, secrets
from tests.llm.test_pages_and_pairs import brute
from tests.llm.test_text_operators import brute_base, brute_lines
from tests.llm.test_tokens import JSON, check_packing


def test_stages_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        seen[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)

    before, after = seen["language_id"]
    assert {r.doc_id for r in before if len(r.text) > 40} <= {r.doc_id for r in after}
    before, after = seen["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(brute_lines([(r.doc_id, r.source, r.text) for r in before], 0.02, 5))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["ngram_jaccard"]
    assert sorted(r.doc_id for r in after) == sorted({c for c, *_ in brute([(r.doc_id, r.text) for r in before]).values()})
    before, after = seen["secret_scans"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        if not brute_base(r.text):
            assert r.text == texts[r.doc_id]
        else:
            assert "[SECRET]" in texts[r.doc_id] and not brute_base(texts[r.doc_id])
    before, after = seen["best_fit_packing"]
    t = Tokenizer.from_file(JSON)
    check_packing(after, {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 2] for r in before})


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "secret_scans", "best_fit_packing"]
    assert secrets.KINDS[:3] == ["assign", "access", "hex"] and jaccard.WORDS == 5 and P.PATTERN


def test_stages_with_nulls_repeats_and_nothing(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept string, _gone_id string, spans string, digest string, host string"
    rows = [
        (1, "the same words here again and again", "en", "s", 35, "x", "x", "x", "x", "x", "x"),
        (1, "the same words here again and again", "en", "s", 35, "x", "x", "x", "x", "x", "x"),
        (2, None, None, None, None, None, None, None, None, None, None),
        (None, "words of their own with a token=abcdefgh12 inside", None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, None, None, None, None, None, None),
        (4, "\n\n\n", "de", "", 3, None, None, None, None, None, None),
        (5, "x" * 300_000, "en", "s", 300_000, None, None, None, None, None, None),
        *((10 + i, f"some plain english words and the number {i}", "en", "s", 40, None, None, None, None, None, None) for i in range(8)),
    ]
    whole = spark.createDataFrame(rows, schema)
    for docs in (whole, whole.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            got = out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(got, docs.schema)
    assert got == []
