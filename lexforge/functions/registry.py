"""Extension points: named and dotted functions, chains of them, and the contracts of models and scorers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators.reports import SUMMARIES

#: Text processors by name: Column to Column.
PROCESSORS: dict[str, Callable[[Column], Column]] = {"lower": F.lower, "trim": F.trim, "strip_quotes": X.strip_quotes, "quote": X.quote_atom}
#: Scorers by name: (value now, best so far) and whether that is better.
SCORERS: dict[str, Callable[[float, float], bool]] = {"ppl": lambda now, best: now < best, "accuracy": lambda now, best: now > best}
#: Readers by the type of data.
READERS = {"text": "lexforge.sources.files.read_lines", "img": "lexforge.sources.media.read_images", "audio": "lexforge.sources.media.read_audio", "vec": "lexforge.sources.media.read_vectors"}


def dotted(path: str) -> Callable:
    """The function of a dotted path."""
    module, _, name = path.rpartition(".")
    found = getattr(import_module(module), name, None) if module else None
    if not callable(found):
        raise LookupError(path)
    return found


def processor(name: str) -> Callable[[Column], Column]:
    return PROCESSORS[name] if name in PROCESSORS else dotted(name)


def apply_chain(column: Column, names: list[str]) -> Column:
    """Processors one after the other; built-in ones stay inside generated code."""
    for n in names:
        column = processor(n)(column)
    return column


def summary(name: str) -> Callable[[Column], Column]:
    return SUMMARIES[name]


def reader(kind: str) -> Callable:
    return dotted(READERS[kind])


def register_sql(spark: SparkSession) -> list[str]:
    """Tree and sub-token functions for SQL."""
    from lexforge.operators.subtokens import pieces
    from lexforge.operators.trees import MalformedTree, height, parse, show

    def safe(f):
        def one(t):
            try:
                return None if t is None else f(parse(t))
            except MalformedTree:
                return None

        return lambda s: s.map(one)

    def tree_height(t: pd.Series) -> pd.Series:
        return safe(height)(t).astype("Int64")

    def tree_text(t: pd.Series) -> pd.Series:
        return safe(show)(t)

    def name_pieces(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else pieces(x))

    made = {"tree_height": (tree_height, "bigint"), "tree_text": (tree_text, "string"), "name_pieces": (name_pieces, "array<string>")}
    for name, (f, kind) in made.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    return sorted(made)


class CorpusModel(ABC):
    """What a model that is trained on a corpus offers; every step takes and gives frames."""

    @abstractmethod
    def process(self, rows: DataFrame) -> DataFrame:
        """Inputs and targets of raw rows."""

    @abstractmethod
    def train(self, train: DataFrame, validation: DataFrame) -> DataFrame:
        """Training history: step, figures of both parts."""

    @abstractmethod
    def predict(self, rows: DataFrame, n_best: int) -> DataFrame:
        """Candidates by falling likelihood."""

    def evaluate(self, rows: DataFrame, truth: str, n_best: int) -> DataFrame:
        from lexforge.operators.reports import top_k_accuracy

        return top_k_accuracy(self.predict(rows, n_best).withColumn("_lf_names", F.transform("candidates", lambda c: c["name"])), truth, "_lf_names")


class DecodeStrategy(ABC):
    """One step of decoding over a frame of hypotheses."""

    @abstractmethod
    def advance(self, alive: DataFrame, scores: DataFrame, step: int) -> DataFrame: ...

    @abstractmethod
    def finished(self, alive: DataFrame, step: int) -> DataFrame: ...


class FrequencyModel(CorpusModel):
    """The simplest model: names by how often they came with a row's key. It trains in one aggregation."""

    def __init__(self, key: str, name: str):
        self.key, self.name, self.counts = key, name, None

    def process(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key, self.name)

    def train(self, train: DataFrame, validation: DataFrame) -> DataFrame:
        n = self.process(train).groupBy(self.key, self.name).agg(F.count("*").alias("n"))
        total = n.groupBy(self.key).agg(F.sum("n").alias("t"))
        self.counts = n.join(total, self.key).withColumn("logprob", F.log(F.col("n") / F.col("t")))
        seen = self.process(validation).join(self.counts, [self.key, self.name], "left")
        return seen.agg(F.lit(1).cast("long").alias("step"), F.exp(-F.avg(F.coalesce("logprob", F.lit(-100.0)))).alias("val_ppl"), (100.0 * F.avg(F.col("n").isNotNull().cast("double"))).alias("val_accuracy"))

    def predict(self, rows: DataFrame, n_best: int) -> DataFrame:
        from lexforge.operators.ordering import top_per_group

        if self.counts is None:
            raise RuntimeError("train first")
        best = top_per_group(self.counts, [self.key], [F.desc("logprob"), F.asc(self.name)], n_best)
        lists = best.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct((-F.col("logprob")).alias("o"), F.col(self.name).alias("name"), "logprob"))).alias("candidates"))
        return rows.join(lists, self.key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<o:double,name:string,logprob:double>>")))
