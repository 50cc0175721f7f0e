import pytest
from pyspark.sql import functions as F

from lexforge.functions import registry
from lexforge.operators import inputs as I
from lexforge.sources import config

KERNEL = "(GProd (Name (Id n)) Explicit (GVar (Id nat)) (GApp (GRef (ConstRef foo_bar) ()) x))"


def test_inputs(spark):
    rows = spark.createDataFrame([("add_0", ["forall", "add0"], KERNEL, None, {"add": 5.0, "forall": float("inf")})], "name string, statement array<string>, kernel string, syntax string, context map<string,double>")
    out = I.project_inputs(rows, ["s", "bsexpl1", "bsexpnpl2", "fsexp"]).first()
    assert out["src.s"] == ["forall", "add", "0"]
    assert "".join(out["src.bsexpl1"]) == "(<GProd>nnat(<GApp>foo_barx))"
    assert "".join(out["src.bsexpnpl2"]) == "<GApp>foo_barx"
    assert out["src.fsexp"] is None
    assert I.project_target(rows, "c").first().tgt == list("add_0")
    assert "".join(I.project_target(rows, "st").first().tgt) == "add_0"
    with pytest.raises(ValueError, match="x"):
        I.project_target(rows, "x")


def test_config():
    assert I.ModelConfig().problems() == []
    bad = I.ModelConfig(inputs="s+s+zz", dropout=2.0, dim_decoder_hidden=3, encoder="odd")
    assert bad.problems() == ["encoder", "inputs", "dropout", "equal hidden sizes"]
    made = I.ModelConfig.from_options({"config-dict.inputs": "s+bsexpl1", "config-dict.use_attn": "False", "config-dict.dropout": "0.1", "other": "x"})
    assert made.input_types == ["bsexpl1", "s"] and made.use_attn is False and made.dropout == 0.1
    assert made.name.startswith("brnn-s+bsexpl1-rnn-st-de_500")


def test_lists(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None)], "g string, n int, v string")
    row = I.to_lists(df, ["v", "w"], ["g"], "n").first()
    assert (row.v, row.w) == ([None, "y"], [None, None])


def test_registry(spark):
    df = spark.createDataFrame([(' "A b" ',)], "t string")
    assert df.select(registry.apply_chain(F.col("t"), ["trim", "strip_quotes", "lower", "pyspark.sql.functions.reverse"]).alias("x")).first().x == "b a"
    with pytest.raises(LookupError):
        registry.processor("nowhere")
    assert registry.SCORERS["ppl"](1.0, 2.0) and registry.reader("vec").__name__ == "read_vectors"
    registry.register_sql(spark)
    assert spark.sql("SELECT tree_height('(a (b))'), tree_text('( a  b )'), name_pieces('a_b')").first()[:] == (2, "(a b)", ["a", "_", "b"])


def test_frequency_model(spark):
    train = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y")], "key string, name string")
    m = registry.FrequencyModel("key", "name")
    with pytest.raises(RuntimeError):
        m.predict(train, 1)
    history = m.train(train, train.limit(1)).first()
    assert history.val_accuracy == 100.0
    rows = spark.createDataFrame([("k", "y"), ("z", "q")], "key string, truth string")
    got = m.evaluate(rows, "truth", 2).first()
    assert (got.n, got.correct_top_1, got.correct_top_2) == (2, 0, 1)


def test_settings(spark, tmp_path):
    (tmp_path / "a.yml").write_text("# c\nbeam: 5\nname: 'x y'\nflag: false\nfiles:\n- a.v\n- b.v\nnone:\n")
    (tmp_path / "b.json").write_text('{"beam": 7, "flag": null}')
    a, b = config.read_settings(spark, str(tmp_path / "a.yml")), config.read_settings(spark, str(tmp_path / "b.json"))
    assert a == {"beam": 5, "name": "x y", "flag": False, "files": ["a.v", "b.v"], "none": None}
    assert config.merged(a, b)["beam"] == 7 and config.merged(a, b)["flag"] is False
    assert config.allowed(a, ["beam"]) == {"beam": 5}
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None})], "x map<string,string>, y map<string,string>")
    assert df.select(config.merge_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": "3"}
    counts = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    assert config.to_listing(counts, "k", "n").first().listing == "- y: 2\n- x: 1"


def test_command_line(spark, sf_dir, capsys, tmp_path):
    from lexforge.__main__ import main

    main(["list"])
    assert "vocab_topk" in capsys.readouterr().out
    main(["sql", "vocab_topk"])
    assert "SELECT" in capsys.readouterr().out
    main(["run", "report_every_n", sf_dir, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
