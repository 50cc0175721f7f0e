"""Beam search with coverage against a loop."""

import math
import random

import pytest

from lexforge.operators import decode as D


def penalty(kind, covered, beta):
    if kind == "wu":
        return -beta * sum(math.log(min(c, 1.0)) for c in covered)
    return beta * (sum(max(c, 1.0) for c in covered) - len(covered))


def loop(start, gains, weights, beam, n_best, end, longest, alpha, kind, beta, stepwise):
    """(score, tokens) of one example, best first; a state for each beam, nothing shared."""
    beams, found, topped = [{"tokens": [start], "logp": 0.0, "covered": None, "taken": 0.0}], [], False
    for step in range(1, longest + 1):
        grown = []
        for b in beams:
            seen = weights.get(b["tokens"][-1])
            if seen is None:
                continue
            covered = seen if b["covered"] is None else [x + y for x, y in zip(b["covered"], seen, strict=True)]
            logp, taken = b["logp"], b["taken"]
            if stepwise and step > 1:
                logp, taken = logp + taken - penalty(kind, covered, beta), penalty(kind, covered, beta)
            for token, gain in gains.get(b["tokens"][-1], {}).items():
                length = ((5 + step + 1) / 6) ** alpha if alpha else 1.0
                grown.append({"tokens": [*b["tokens"], token], "logp": logp + gain, "covered": covered, "taken": taken, "score": (logp + gain) / length})
        grown = sorted(grown, key=lambda b: (-b["score"], b["tokens"]))[:beam]
        over = [b["tokens"][-1] == end or step == longest for b in grown]
        found += [(b["score"] - (0 if stepwise else penalty(kind, b["covered"], beta)), b["tokens"]) for b, o in zip(grown, over, strict=True) if o]
        topped |= bool(over and over[0])
        beams = [b for b, o in zip(grown, over, strict=True) if not o]
        if not beams or topped and len(found) >= n_best:
            break
    return sorted(found, key=lambda x: (-x[0], x[1]))[:n_best]


@pytest.mark.parametrize("kind", ["wu", "summary"])
@pytest.mark.parametrize("stepwise", [True, False])
@pytest.mark.parametrize("by_example", [True, False])
def test_against_a_loop(spark, kind, stepwise, by_example):
    rng = random.Random(f"{kind}{stepwise}{by_example}")
    tokens, examples = range(6), range(3)
    gains = {p: {t: math.log(rng.random()) for t in tokens if rng.random() < 0.8} for p in tokens}
    weights = {e: {p: [rng.random() for _ in range(4)] for p in tokens if p != 5} for e in examples}
    scores = spark.createDataFrame([(p, t, g) for p, x in gains.items() for t, g in x.items()], "prev int, token int, logp double")
    if by_example:
        attention = spark.createDataFrame([(e, p, w) for e, x in weights.items() for p, w in x.items()], "example long, prev int, weights array<double>")
    else:
        weights = dict.fromkeys(examples, weights[0])
        attention = spark.createDataFrame([(p, w) for p, w in weights[0].items()], "prev int, weights array<double>")
    starts = spark.createDataFrame([(e, e + 1) for e in examples], "example long, token int")
    got = D.beam_search(starts, scores, 3, 3, 0, 5, 0.7, attention=attention, coverage=kind, beta=0.8, stepwise=stepwise).orderBy("example", "rank").collect()
    want = [(e, k + 1, s, t) for e in examples for k, (s, t) in enumerate(loop(e + 1, gains, weights[e], 3, 3, 0, 5, 0.7, kind, 0.8, stepwise))]
    assert [(r["example"], r["rank"], r["tokens"]) for r in got] == [(e, k, t) for e, k, _, t in want]
    assert [r["score"] for r in got] == pytest.approx([s for *_, s, _ in want])


def test_coverage_changes_what_is_chosen(spark):
    # The likelier token looks where the start has looked; the penalty turns the choice.
    scores = spark.createDataFrame([(1, 2, -0.1), (1, 3, -0.4), (2, 2, -0.1), (3, 3, -0.2), (2, 0, -1.0), (3, 0, -1.0)], "prev int, token int, logp double")
    attention = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "prev int, weights array<double>")
    starts = spark.createDataFrame([(0, 1)], "example long, token int")
    best = lambda **more: D.beam_search(starts, scores, 2, 1, 0, 4, **more).first()["tokens"][1]
    assert best() == 2 and best(attention=attention, coverage="summary", beta=1.0, stepwise=True) == 3
