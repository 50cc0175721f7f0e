"""Queries over attention and optimizer steps on the given vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexforge.operators import attention as A
from lexforge.operators import optimize as P
from lexforge.plans.catalog import query
from lexforge.runtime import table

#: Vectors of a sequence, heads, and the furthest distance with a vector of its own.
LENGTH, HEADS, FURTHEST = 16, 4, 3


def _split_grids(spark, sf_dir):
    """Each vector of 64 components as four grids of 4 x 4."""
    rows = lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", h * 16 + i * 4 + 1, F.lit(4)), lambda x: x.cast("double")))
    grids = F.transform(F.sequence(F.lit(0), F.lit(3)), rows)
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.posexplode(grids).alias("head", "grid"))


@query(f"""
WITH g AS (SELECT vec_id, head::INTEGER AS head, list_transform(range(0, 16), lambda c: exp(embedding[head * 16 + c + 1]::DOUBLE)) AS w FROM embeddings, range(0, 4) r(head) WHERE len(embedding) = 64),
d AS (SELECT unnest(range(0, 5)) AS p),
trees AS (SELECT row_number() OVER () AS tree, p FROM (SELECT [a.p, b.p, c.p, e.p] AS p FROM d a, d b, d c, d e)
  WHERE len(list_filter(p, lambda x: x = 4)) = 1
    AND list_min(list_transform(range(0, 4), lambda j: CASE WHEN p[j + 1] = 4 OR p[p[j + 1] + 1] = 4 OR p[p[p[j + 1] + 1] + 1] = 4 OR p[p[p[p[j + 1] + 1] + 1] + 1] = 4 THEN 1 ELSE 0 END)) = 1),
m AS (SELECT vec_id, head, w, p, list_product(list_transform(range(0, 4), lambda j: CASE WHEN p[j + 1] = 4 THEN w[j * 5 + 1] ELSE w[p[j + 1] * 4 + j + 1] + {A.EPSILON}::DOUBLE END)) AS mass FROM g, trees),
z AS (SELECT vec_id, head, sum(mass) AS whole FROM m GROUP BY ALL),
arcs AS (SELECT vec_id, head, CASE WHEN p[j + 1] = 4 THEN j ELSE p[j + 1] END AS i, j, sum(mass * CASE WHEN p[j + 1] = 4 THEN 1 ELSE w[p[j + 1] * 4 + j + 1] / (w[p[j + 1] * 4 + j + 1] + {A.EPSILON}::DOUBLE) END) AS mass FROM m, range(0, 4) r(j) GROUP BY ALL)
SELECT vec_id, head, i::INTEGER AS i, j::INTEGER AS j, round(mass / whole, 6) AS p FROM arcs JOIN z USING (vec_id, head)""")
def tree_attention(spark, sf_dir):
    """Probabilities of arcs over all trees of four nodes; the SQL adds up the 64 trees one by one."""
    found = A.tree_marginals(_split_grids(spark, sf_dir), "grid", "marginals")
    rows = found.select("vec_id", "head", F.posexplode("marginals").alias("i", "row"))
    return rows.select("vec_id", "head", "i", F.posexplode("row").alias("j", "x")).select("vec_id", "head", "i", "j", F.round("x", 6).alias("p"))


def _relations() -> list[list[float]]:
    return [[math.sin(d * 16 + c) / 2 for c in range(16)] for d in range(2 * FURTHEST + 1)]


def _heads_sql(causal: bool) -> str:
    part = 64 // HEADS
    relation = f"list_transform(range(0, {part}), lambda c: sin((greatest(least(b.p - a.p, {FURTHEST}), -{FURTHEST}) + {FURTHEST}) * {part} + c::DOUBLE) / 2)"
    head = lambda side: f"list_transform({side}.embedding[h * {part} + 1:h * {part} + {part}], lambda x: x::DOUBLE)"
    return f"""
WITH e AS (SELECT *, vec_id // {LENGTH} AS s, vec_id % {LENGTH} AS p FROM embeddings),
pairs AS (SELECT a.vec_id, h, {head("a")} AS q, {head("b")} AS k, {relation} AS r FROM e a JOIN e b ON a.s = b.s {"AND b.p <= a.p" if causal else ""}, range(0, {HEADS}) t(h)),
scores AS (SELECT vec_id, h, k, r, list_sum(list_transform(range(1, {part + 1}), lambda c: q[c] * (k[c] + r[c]))) / sqrt({part}) AS x FROM pairs),
weights AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, h)) AS w FROM scores),
shares AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id, h) AS a FROM weights)
SELECT vec_id, h * {part} + c AS dim, round(sum(a * (k[c + 1] + r[c + 1])), 5) AS context, round(max(a), 5) AS top FROM shares, range(0, {part}) u(c) GROUP BY ALL"""


def _heads(spark, sf_dir, causal: bool):
    # Blocks of seven, so that sequences of sixteen are met in several.
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / LENGTH).alias("s"), (F.col("vec_id") % LENGTH).alias("p"), "embedding")
    found = A.attend(rows, "s", "p", "embedding", "embedding", "embedding", HEADS, _relations(), causal, block=7)
    cells = found.select((F.col("s") * LENGTH + F.col("p")).alias("vec_id"), "top", F.posexplode("context").alias("dim", "x"))
    top = F.get("top", F.floor(F.col("dim") / (64 // HEADS)).cast("int"))
    return cells.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("context"), F.round(top, 5).alias("top"))


@query(_heads_sql(False))
def multi_head_attention(spark, sf_dir):
    """Four heads over sequences of sixteen vectors, with vectors of clipped distances."""
    return _heads(spark, sf_dir, False)


@query(_heads_sql(True))
def causal_attention(spark, sf_dir):
    """The same, where a position sees itself and what comes before it."""
    return _heads(spark, sf_dir, True)


STEPS, LIMIT = 3, 5.0
HOW = P.Factored(rate=0.1, weight_decay=0.01)


def _step_sql(t: int) -> str:
    """One step from ``s{t - 1}`` to ``s{t}``, with the decays of step ``t``."""
    decay = lambda b: b * (1 - b ** (t - 1)) / (1 - b**t)
    b1, b2 = decay(HOW.beta1), decay(HOW.beta2)
    fall = {"rate": HOW.rate, "wd": HOW.weight_decay}
    return f"""
n{t} AS (SELECT least(1, {LIMIT}::DOUBLE / (sqrt(sum((value - name / 10.0::DOUBLE) ** 2)) + 1e-6::DOUBLE)) AS f FROM s{t - 1}),
g{t} AS (SELECT *, (value - name / 10.0::DOUBLE) * f AS g FROM s{t - 1}, n{t}),
m{t} AS (SELECT *, moment * {b1!r}::DOUBLE + g * (1 - {b1!r}::DOUBLE) AS moment2,
  row_square * {b2!r}::DOUBLE + (1 - {b2!r}::DOUBLE) * sum(g * g + 1e-30::DOUBLE) OVER (PARTITION BY name, row) AS r2,
  col_square * {b2!r}::DOUBLE + (1 - {b2!r}::DOUBLE) * sum(g * g + 1e-30::DOUBLE) OVER (PARTITION BY name, col) AS c2,
  greatest({HOW.least_scale}::DOUBLE, sqrt(avg(value * value) OVER (PARTITION BY name))) AS scale FROM g{t}),
v{t} AS (SELECT m.*, moment2 / (1 - {b1!r}::DOUBLE ** {t}) / sqrt(r2 * c2 / total) AS u FROM m{t} m JOIN (SELECT name, sum(c2) AS total FROM (SELECT DISTINCT name, col, c2 FROM m{t}) GROUP BY name) USING (name)),
u{t} AS (SELECT *, u / greatest(1, sqrt(avg(u * u) OVER (PARTITION BY name)) / {HOW.clip}::DOUBLE) AS u2 FROM v{t}),
s{t} AS (SELECT name, row, col, (value - {fall["rate"]}::DOUBLE * scale * u2) * (1 - {fall["wd"]}::DOUBLE * {fall["rate"]}::DOUBLE * scale) AS value, moment2 AS moment, r2 AS row_square, c2 AS col_square FROM u{t})"""


@query(f"""
WITH s0 AS (SELECT label AS name, vec_id AS row, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding)::DOUBLE AS value, 0::DOUBLE AS moment, 0::DOUBLE AS row_square, 0::DOUBLE AS col_square FROM embeddings),
{",".join(_step_sql(t) for t in range(1, STEPS + 1))}
SELECT name, row, col::BIGINT AS col, round(value, 6) AS value, round(moment, 6) AS moment FROM s{STEPS}""")
def factored_updates(spark, sf_dir):
    """Three clipped, factored steps of a matrix for each label towards a target of its own."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").alias("name"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    state = P.begin(cells)
    for _ in range(STEPS):
        slope = state.cells.select("name", "row", "col", (F.col("value") - F.col("name") / 10).alias("gradient"))
        state = P.step(state, P.clip_norm(slope, LIMIT), HOW)
    return state.cells.select("name", "row", "col", F.round("value", 6).alias("value"), F.round("moment", 6).alias("moment"))
