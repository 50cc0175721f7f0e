import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import entries, pack
from lexforge.llm.tokenize import TextCodec, decode_ids, encode_texts, load_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return TextCodec(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_library_on_any_text(library, codec, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_equals_library_on_joined_entries(library, codec):
    rng, entries_ = random.Random(0), list(load_ranks(RANKS))
    for _ in range(3000):
        s = "".join(rng.choice(entries_).decode("utf-8", "ignore") for _ in range(rng.randrange(1, 8)))
        assert codec.encode(s) == library.encode_ordinary(s)
    for s in ("a" * 3000, "ab" * 2000, " " * 500 + "x", "<|endoftext|>", "\n \n  x \t y", "é" * 777, "\x1c\x85\xa0 x"):
        assert codec.encode(s) == library.encode_ordinary(s)


def test_spark_round_trip(spark, sf_dir, library):
    rows = spark.createDataFrame([(1, "Hello  world", "x"), (2, None, "y"), (3, "", None), (1, "Hello  world", "x")], "doc_id long, text string, IDS string")
    out = encode_texts(rows, RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    got = out.orderBy("doc_id").collect()
    assert list(got[0].ids) == library.encode_ordinary("Hello  world")
    assert list(got[2].ids) == [] and list(got[3].ids) == []
    back = decode_ids(out, RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in back] == [b"Hello  world"] * 2 + [b"", b""]
    assert encode_texts(rows.limit(0), RANKS, P.PATTERN).count() == 0


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entries.op1_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- packing ---------------------------------------------------------------------


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit(lengths):
    places, fill = pack.best_fit(lengths, 64)
    seen = {}
    for n, (b, at) in zip(lengths, places, strict=True):
        assert not seen.setdefault(b, set()) & set(range(at, at + n))
        seen[b] |= set(range(at, at + n))
    assert [len(seen[b]) for b in range(len(fill))] == fill
    assert all(seen[b] == set(range(fill[b])) for b in seen)
    assert max(fill, default=0) <= 64
    assert sum(2 * f <= 64 for f in fill) <= 1


@pytest.mark.parametrize(("n", "pieces"), [(0, []), (1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, pieces):
    assert pack.cut(n, 1024) == pieces


def check_packing(rows, ids, capacity=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, ps in by_doc.items():
        ps.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in ps] == [(i, s, n) for i, (s, n) in enumerate(pack.cut(len(ids[k]), capacity))]
        for r in ps:
            blob = b"".join(i.to_bytes(4, "little") for i in ids[k][r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(blob)
    for ps in by_seq.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-sum(map(len, ids.values())) // capacity)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_query_packs_everything(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2] for d in docs}
    used, least = check_packing(entries.op2_best_fit_packing(spark, sf_dir).collect(), ids)
    assert used <= least + max(2, least // 50)


def test_tree_merge_over_many_partitions(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else " ".join("word" for _ in range(rng.choice([0, 3, 200, 400, 600, 1030])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    used, least = check_packing(pack.pack(df, JSON, P.PATTERN, 2, fan_in=2).collect(), ids)
    alone, _ = check_packing(pack.pack(df, JSON, P.PATTERN, 2, fan_in=2, nearly_full=1024).collect(), ids)
    assert least <= used <= alone


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string, bin long")
    assert pack.pack(df, JSON, P.PATTERN, 2).count() == 0
    df = spark.createDataFrame([(None, "a", 1), (7, "b", 2), (7, "b", 2)], "doc_id long, text string, bin long")
    rows = pack.pack(df, JSON, P.PATTERN, 2).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["7", "7", "None"]


@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "word", "'s", "é", "12", "<|"]), max_size=12).map("".join)))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(tokenizer, text):
    blob = pack.token_bytes(JSON, P.PATTERN)(text)
    assert [int.from_bytes(blob[k : k + 4], "little") for k in range(0, len(blob), 4)] == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(spark, tokenizer):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>" * 3000), (3, "a<|endoftext|>"), (4, None), (5, "x" * 200_000), (6, "long words " * 100_000)]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert ids[1] == [31373, 220, 50256, 995, 2]
    check_packing(pack.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON, P.PATTERN, 2).collect(), ids)


def test_unknown_tokenizers_are_refused(tmp_path):
    import json

    with open(JSON, encoding="utf-8") as f:
        said = json.load(f)
    (tmp_path / "t.json").write_text(json.dumps(said | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        pack.TokenBytes(str(tmp_path / "t.json"), P.PATTERN)
