"""Model inputs and targets of lemma rows, and the configuration that selects them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexforge.operators.chop import level
from lexforge.operators.subtokens import split_name
from lexforge.operators.trees import dfs, parse

# Input types as (column, tree level, with parentheses), and output types.
INPUTS = {
    "s": ("statement", None, False),
    "bsexp": ("kernel", "whole", True),
    "bsexpl1": ("kernel", "kernel", True),
    "bsexpl2": ("kernel", "kernel-2", True),
    "bsexpnp": ("kernel", "whole", False),
    "bsexpnpl1": ("kernel", "kernel", False),
    "bsexpnpl2": ("kernel", "kernel-2", False),
    "bsexpd10": ("kernel", "depth-10", True),
    "bsexprnd": ("kernel", "kernel-random", True),
    "bsexpl1x": ("kernel", "kernel-x", True),
    "fsexp": ("syntax", "syntax-0", True),
    "fsexpnp": ("syntax", "syntax-0", False),
    "fsexpl1": ("syntax", "syntax-1", True),
    "fsexpnpl1": ("syntax", "syntax-1", False),
    "fsexpd10": ("syntax", "depth-10", True),
    "fsexprnd": ("syntax", "syntax-random", True),
    "fsexpl1x": ("syntax", "syntax-x", True),
}
OUTPUTS = {"c": "characters", "st": "sub-tokens"}
ENCODERS, DECODERS = ["rnn", "brnn", "mean", "transformer", "cnn"], ["rnn", "transformer", "cnn"]
INPUT_MAX = 3000


@dataclass(frozen=True)
class ModelConfig:
    """What a model is made of; ``problems`` says what is wrong with it."""

    inputs: str = "s"
    output: str = "st"
    encoder: str = "brnn"
    decoder: str = "rnn"
    dim_embed: int = 500
    dim_encoder_hidden: int = 500
    dim_decoder_hidden: int = 500
    rnn_num_layers: int = 2
    dropout: float = 0.5
    use_attn: bool = False
    use_copy: bool = False
    min_input_freq: int = 1
    early_stopping: int = 3
    keep_checkpoints: int = 3
    input_max: int = INPUT_MAX
    pretrain: str | None = None

    @property
    def input_types(self) -> list[str]:
        return sorted(x for x in self.inputs.split("+") if x)

    @property
    def name(self) -> str:
        s = f"{self.encoder}-{self.inputs}-{self.decoder}-{self.output}-de_{self.dim_embed}-deh_{self.dim_encoder_hidden}-ddh_{self.dim_decoder_hidden}-rnl_{self.rnn_num_layers}-do_{self.dropout}-vift_{self.min_input_freq}"
        return s + (f"-pt_{self.pretrain}" if self.pretrain else "") + "+attn" * self.use_attn + "+copy" * self.use_copy

    def problems(self) -> list[str]:
        types = self.input_types
        checks = {
            "encoder": self.encoder in ENCODERS,
            "decoder": self.decoder in DECODERS,
            "inputs": bool(types) and set(types) <= set(INPUTS) and len(set(types)) == len(types),
            "output": self.output in OUTPUTS,
            "sizes": min(self.dim_embed, self.dim_encoder_hidden, self.dim_decoder_hidden, self.rnn_num_layers) > 0,
            "dropout": 0 <= self.dropout <= 1,
            "equal hidden sizes": self.dim_encoder_hidden == self.dim_decoder_hidden,
            "checkpoints": self.keep_checkpoints >= self.early_stopping,
            "input_max": self.input_max == INPUT_MAX,
        }
        return [k for k, ok in checks.items() if not ok]

    @classmethod
    def from_options(cls, options: dict[str, str], prefix: str = "config-dict.") -> ModelConfig:
        """From ``config-dict.key`` options; values take the fields' types, other keys are passed over."""
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        given = {k[len(prefix) :]: v for k, v in options.items() if k.startswith(prefix)}
        convert = lambda k, v: v.lower() != "false" if kinds[k] is bool else v if kinds[k] is type(None) else kinds[k](v)
        return cls(**{k: convert(k, v) for k, v in given.items() if k in kinds})

    def to_dict(self) -> dict:
        return asdict(self)


def _tree_tokens(kind: str, tree, text: str) -> list[str]:
    _, name, parentheses = INPUTS[kind]
    changed = level(tree, name, seed=text)
    return [] if changed is None else dfs(changed, parentheses)


def _row_inputs(kinds: list[str], row: dict, longest: int) -> tuple[list[list[str] | None], str | None]:
    """The tokens of each input type of a row, and what is wrong with it. Each tree is parsed once."""
    context, trees, out, wrong = dict(row["context"] or {}), {}, [], None
    for kind in kinds:
        column, name, _ = INPUTS[kind]
        value = row[column]
        try:
            if value is None or name is None:
                tokens = value
            else:
                if column not in trees:
                    trees[column] = parse(value)
                tokens = _tree_tokens(kind, trees[column], value)
        except ValueError as e:
            tokens, wrong = None, wrong or f"{kind}: {e}"
        out.append(None if tokens is None else [s for t in tokens for s in split_name(t, context)][:longest])
    return out, wrong


def project_inputs(rows: DataFrame, kinds: list[str], longest: int = INPUT_MAX) -> DataFrame:
    """``rows`` with a column ``src.<kind>`` of tokens for each input type, and ``input_error``.

    One pass over the rows for all types, cut to ``longest`` tokens each. A null
    tree gives null; so does one that does not parse or does not have the
    expected shape, and input_error then says which type failed first and why.
    """
    made = [f"src.{k}" for k in kinds]
    schema = StructType([*rows.schema.fields, *(StructField(m, ArrayType(StringType())) for m in made), StructField("input_error", StringType())])
    names = [*rows.columns, *made, "input_error"]

    def run(batches):
        for b in batches:
            found = [_row_inputs(kinds, r, longest) for r in b.select(["statement", "kernel", "syntax", "context"]).to_pylist()]
            new = [pa.array([tokens[k] for tokens, _ in found], pa.list_(pa.string())) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array([wrong for _, wrong in found], pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def project_target(rows: DataFrame, output: str, name: str = "name", context: str = "context") -> DataFrame:
    """``rows`` with ``tgt``: the name's characters or sub-tokens."""
    from lexforge.operators.subtokens import split_in_context

    if output == "c":
        return rows.withColumn("tgt", F.filter(F.split(name, "", -1), lambda c: c != ""))
    if output == "st":
        return rows.withColumn("tgt", split_in_context(F.col(name), F.col(context)))
    raise ValueError(output)


def to_lists(rows: DataFrame, columns: list[str], by: list[str], order: str) -> DataFrame:
    """One row of parallel lists in order for each group; a column that the rows lack gives nulls."""
    present = rows.select(*by, F.col(order).alias("_lf_o"), *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))
    packed = present.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_lf_o", *columns))).alias("_lf_r"))
    return packed.select(*by, *(F.col(f"_lf_r.{c}").alias(c) for c in columns))
