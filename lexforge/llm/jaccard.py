"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Rows whose word sequences are equal are one text class; the join runs on the
classes. In every tree of the forest a class has a path of minima; classes below
one node share a prefix. The join starts at the longest prefixes and verifies
what meets there, on whole shingle sets. From the similarities of the pairs found
it estimates how many more there are that met nowhere, and shortens the prefixes
until that share of the links is negligible (``LOST``). One pair at the threshold
is always expected beside those seen. At the shortest prefixes even pairs at the
threshold meet with the target recall.

A node below which the same classes meet as in an earlier tree, or as below one
longer prefix, adds no pair and is left out. The rest is verified in blocks of
bounded rows and bytes. A pair counts at its longest prefix in the first tree
where it meets, so counts add up without the pairs ever being listed: a block
gives each class its number of links and one edge to its component.

Groups of near copies are balls: their members meet one leader at the longest
prefix. What a member lacks and adds beside the ball's centre bounds its
similarity to every other member: those whose bounds suffice are linked for
sure, and are counted from a histogram of the ball. Members near the centre (the
core) are all linked with one another, so blocks of one core never meet, and a
node that holds one core only is not verified at all. So a group of near copies costs rows
in proportion to its members, in shuffles as in work.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.tokenize import WordCache
from lexforge.runtime import bounded_batches, checked_broadcast, col, fresh, join_back, salted_join, stage_table

WORDS, THRESHOLD = 5, 0.8
#: Trees, longest prefix, and the share of pairs at the threshold that meet at the shortest prefixes.
TREES, MAX_DEPTH, RECALL = 24, 7, 0.9999
#: Share of the links that may be expected to be lost where prefixes stay longer.
LOST = 1e-6
#: Classes and bytes of shingles of one side of a verification block.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Rows of candidates that are sent to all tasks at most (about 60 bytes each).
BROADCAST_KEYS = 50_000
#: Text classes with more rows than both this and a 10,000th of all rows are joined back by broadcast.
HOT_ROWS, HOT_SHARE = 500, 10_000

#: How often a leader is replaced by its own leader.
JUMPS = 2
#: Members that a centre is made from, about.
CENTRE_SAMPLE = 15

#: Hashed words held by a task.
SHINGLE_WORDS = 1 << 17

#: Room for rounding where similarities are compared.
_EPS = 1e-9

_WORD = re.compile(r"\w+")


def missed(similarity, depth: int, trees: int):
    """The share of pairs of a similarity that meet in none of the trees with prefixes of ``depth``."""
    return (1 - similarity**depth) ** trees


def depths(threshold: float = THRESHOLD, trees: int = TREES, longest: int = MAX_DEPTH, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the longest to the one with which pairs at the threshold meet with the target recall."""
    out = [longest]
    while out[-1] > 1 and 1 - missed(threshold, out[-1], trees) < recall:
        out.append(out[-1] - 1)
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word n-grams; a text of fewer words has one shingle, of all its words."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self._hash = WordCache(lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"), SHINGLE_WORDS).__getitem__
        self._weights = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        n = min(self.words, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * self._weights[k]
        return np.unique(_mix(total))


class Forest:
    """The nodes of a shingle set: hashes of its prefixes, for each of ``lengths`` one in every tree."""

    def __init__(self, trees: int, lengths: list[int]):
        self.trees, self.lengths, deepest = trees, lengths, max(lengths)
        seeds = _mix(np.arange(1, 2 * trees * deepest + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self._a = (seeds[: trees * deepest] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self._b = (seeds[trees * deepest :] >> np.uint64(32)).astype(np.uint32)
        self._fold = _mix(np.arange(1, deepest + 1, dtype=np.uint64)) | np.uint64(1)
        self._tree = _mix(np.arange(trees, dtype=np.uint64) + np.uint64(77))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self._a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024, None] * self._a
            part += self._b
            np.minimum(low, part.min(axis=0), out=low)
        rows = _mix(low.astype(np.uint64) + np.uint64(1)).reshape(self.trees, -1)
        sums = (rows * self._fold).cumsum(axis=1, dtype=np.uint64)
        return np.concatenate([_mix(sums[:, d - 1] + self._tree + np.uint64(d)) for d in self.lengths]).view(np.int64)


def _signed(docs: DataFrame, doc_id: str, text: str, words: int, trees: int, lengths: list[int]) -> DataFrame:
    def run(batches):
        shingler, forest = Shingler(words), Forest(trees, lengths)
        for batch in batches:
            digests, keys, sizes = [], [], []
            for v in batch.column(2):
                w = words_of(v.as_py())
                s = shingler(w)
                digests.append(hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() if w else None)
                keys.append(forest.keys(s) if w else np.zeros(0, np.int64))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "sha", "digest", "keys", "size"])

    rows = docs.select(col(doc_id).alias("doc_id"), _sha(text).alias("sha"), F.coalesce(col(text), F.lit("")).alias("text"))
    return bounded_batches(rows).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, sha binary, digest binary, keys array<bigint>, size bigint")


def _sha(text: str):
    return F.unhex(F.sha2(F.coalesce(col(text), F.lit("")), 256))


def _at(reps: DataFrame, trees: int, level: int, *more: str) -> DataFrame:
    """Each class once for every tree, with the node it is below there; of longer prefixes, too, for all but the first level."""
    whole = reps.select("node", *more, "keys", F.posexplode(F.slice("keys", trees * level + 1, trees)).alias("tree", "key"))
    above = F.get("keys", F.col("tree") + trees * (level - 1)) if level else F.lit(None).cast("bigint")
    return whole.select("node", *more, "tree", "key", above.alias("longer"))


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set): the shingle sets of the ``wanted`` classes (node, id, sha), from one row of each."""
    count = wanted.count()
    texts = docs.select(col(doc_id).alias("id2"), _sha(text).alias("sha2"), col(text).alias("text"))
    found = texts.join(checked_broadcast(wanted, count, BROADCAST_KEYS), (F.col("sha") == F.col("sha2")) & F.col("id").eqNullSafe(F.col("id2")))

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(words_of(v.as_py())).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    sets = stage_table(bounded_batches(found.select("node", "text")).mapInArrow(run, "node bigint, set binary"), "sets")
    # Rows that share id and text are one document.
    return sets if sets.count() == count else sets.dropDuplicates(["node"])


def _balls(reps: DataFrame, sets: DataFrame, trees: int, threshold: float, rows: int) -> DataFrame:
    """(node, ball, rho, most): classes that belong together, how far each is from their centre, and how far two may be.

    The centre is the set of the shingles that more than half of a bounded
    sample of the members have: a yardstick, no text. With i shingles of the
    centre lacking and j added, rho is i + threshold * j. Two members are
    similar for sure if their rhos make no more than ``most``, (1 - threshold)
    times the centre's shingles. A ball is named by the member nearest to its
    centre, to which all others in it are similar for sure.
    """
    hot = max(HOT_ROWS, rows // HOT_SHARE)
    below = _at(reps, trees, 0)
    heads = below.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    # The other head that a class meets in most trees leads it, or the one that leads that head, and so on up.
    met = below.select("key", "node").join(heads, "key").groupBy("node", "head").agg(F.count("*").alias("trees"))
    other = F.when(F.col("head") < F.col("node"), F.struct("trees", (-F.col("head")).alias("minus")))
    led = met.groupBy("node").agg(F.max(other).alias("m")).select("node", F.coalesce(-F.col("m.minus"), "node").alias("ball"))
    for _ in range(JUMPS):
        led = stage_table(led, "led", rows)
        up = led.join(led.select("ball").distinct().withColumnRenamed("ball", "node"), "node").select(F.col("node").alias("ball"), F.col("ball").alias("up"))
        sizes = led.groupBy("ball").agg(F.count("*").alias("n")).join(up, "ball")
        led = join_back(led, sizes, "ball", "n", hot).select("node", F.col("up").alias("ball"))
    led = stage_table(led, "led", rows)
    sizes = led.groupBy("ball").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage_table(join_back(led, sizes, "ball", "n", hot), "sized", rows)
    sample = members.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.col("n")) < CENTRE_SAMPLE).join(sets, "node")
    centres = sample.select("ball", "n", "set").groupBy("ball").applyInArrow(_centre, "ball bigint, n bigint, centre binary")

    def run(batches):
        for batch in batches:
            rho, most = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                c = len(np.intersect1d(x, y, assume_unique=True))
                rho.append(len(y) - c + threshold * (len(x) - c))
                most.append((1 - threshold) * len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rho, pa.float64()), pa.array(most, pa.float64())], names=["node", "ball", "rho", "most"])

    pairs = salted_join(members.join(sets, "node"), centres, "ball", "n", F.xxhash64("node"), HOT_ROWS).select("node", "ball", "set", "centre")
    placed = stage_table(bounded_batches(pairs).mapInArrow(run, "node bigint, ball bigint, rho double, most double").filter(F.col("rho") <= F.col("most") + _EPS), "placed", rows)
    hubs = placed.groupBy("ball").agg(F.min(F.struct("rho", "node")).alias("hub"), F.count("*").alias("n"))
    near = F.col("rho") + F.col("hub.rho") <= F.col("most") + _EPS
    return stage_table(join_back(placed, hubs, "ball", "n", hot).filter(near).select("node", F.col("hub.node").alias("ball"), "rho", "most"), "balls", rows)


def _centre(table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(v.as_py(), np.uint64) for v in table["set"]]
    found, times = np.unique(np.concatenate(sets), return_counts=True)
    centre = found[2 * times > len(sets)] if len(sets) > 2 else sets[0]
    return pa.table({"ball": table["ball"][:1], "n": table["n"][:1], "centre": pa.array([centre.tobytes()], pa.binary())})


def _sure_links(balls: DataFrame, rows: int) -> DataFrame:
    """(node, links): how many others of its ball each class is similar to for sure."""
    steps = balls.groupBy("ball", "rho").agg(F.count("*").alias("n")).groupBy("ball").agg(F.collect_list(F.struct("rho", "n")).alias("steps"), F.sum("n").alias("n"))
    sizes = steps.select("ball", "n")
    near = F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + F.when(x["rho"] + F.col("rho") <= F.col("most") + _EPS, x["n"]).otherwise(0))
    itself = (2 * F.col("rho") <= F.col("most") + _EPS).cast("long")
    return salted_join(join_back(balls, sizes, "ball", "n", max(HOT_ROWS, rows // HOT_SHARE)), steps, "ball", "n", F.xxhash64("node"), HOT_ROWS).select("node", (near - itself).alias("links")).filter("links > 0")


def _members(below: DataFrame, first: bool, block: int, rows: int) -> DataFrame:
    """(key, tree, lo, hi, block, node): each class once for every verification block that it takes part in."""
    nodes = below.groupBy("key").agg(
        F.count("*").alias("n"), F.min("tree").alias("tree"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"),
        (F.bool_and("core") & (F.min("ball") == F.max("ball"))).alias("settled"), (F.min("longer") == F.max("longer")).alias("as_above"),
    ).filter("n > 1 AND NOT coalesce(settled, false)")
    if not first:
        nodes = nodes.filter("NOT as_above")
    # Of nodes with the same classes below them, that of the first tree; pairs in it meet there first.
    kept = stage_table(nodes.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "key", "size")).alias("m")).select("m.tree", "m.key", "m.size", "n"), "nodes", rows)
    small = (F.col("n") <= block) & (8 * F.col("size") <= BLOCK_BYTES)
    zero = F.lit(0)
    met = below.select("key", "node").join(kept.filter(small).select("key", "tree"), "key").select("key", "tree", zero.alias("lo"), zero.alias("hi"), zero.alias("block"), "node")
    return met.unionByName(_blocks(below, kept.filter(~small).select("key", "tree"), block))


def _blocks(below: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """The members of large nodes, dealt into blocks; blocks of one core do not meet."""
    rows = below.select("key", "node", "size", F.when(F.col("core"), F.col("ball")).alias("core")).join(large, "key")
    cores = rows.groupBy("key", "core").agg(F.count("*").alias("n"), F.sum("size").alias("size")).withColumn("own", F.when(F.col("n") > block, F.col("core")))
    parts = cores.groupBy("key", "own").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("n"))
    layout = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "n"))).alias("parts"))
    up_to = lambda own: F.aggregate(F.filter("parts", lambda p: p["own"] < own), F.lit(0), lambda s, p: s + p["n"])
    whole = F.aggregate("parts", F.lit(0), lambda s, p: s + p["n"])
    mine = F.when(F.exists("parts", lambda p: p["own"] == F.col("core")), F.col("core")).otherwise(F.lit(-1))
    dealt = rows.select("key", "tree", "node", "core").join(layout, "key").withColumn("own", mine).withColumn("first", up_to(F.col("own"))).withColumn("size", F.filter("parts", lambda p: p["own"] == F.col("own"))[0]["n"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("size")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), whole - 1), lambda o: (F.col("own") == -1) | (o < F.col("first")) | (o >= F.col("first") + F.col("size")))
    return dealt.withColumn("other", F.explode(others)).select("key", "tree", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")


class _Group:
    """Classes of one block pair: their nodes in the forest, balls and shingle sets."""

    def __init__(self, rows: list[dict], trees: int):
        self.rows, self.trees = rows, trees
        self.sets = [np.frombuffer(r["set"], np.uint64) for r in rows]

    def links(self, threshold: float, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are similar, meet here first and are not sure anyway; and the similarity of all pairs looked at."""
        n, tree, trees = len(self.rows), self.rows[0]["tree"], self.trees
        keys = np.stack([r["keys"] for r in self.rows])
        new = ~np.eye(n, dtype=bool)
        for k in [*range(trees * level, trees * level + tree), *(range(trees * (level - 1), trees * level) if level else ())]:
            new &= keys[:, None, k] != keys[None, :, k]
        block = np.array([r["block"] for r in self.rows])
        if self.rows[0]["lo"] != self.rows[0]["hi"]:
            new &= block[:, None] != block[None, :]
        ball = np.array([-1 if r["ball"] is None else r["ball"] for r in self.rows])
        rho = np.array([r["rho"] or 0.0 for r in self.rows])
        most = np.array([r["most"] or 0.0 for r in self.rows])
        new &= (ball[:, None] != ball[None, :]) | (ball[:, None] < 0) | (rho[:, None] + rho[None, :] > most[:, None] + _EPS)
        sizes = np.array([len(s) for s in self.sets], np.float64)
        new &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - _EPS
        if not new.any():
            return new, np.zeros((n, n))
        used = np.nonzero(new.any(axis=1))[0]
        all_ = np.concatenate([self.sets[i] for i in used])
        owner = np.repeat(used, [len(self.sets[i]) for i in used])
        _, place, times = np.unique(all_, return_inverse=True, return_counts=True)
        shared = times > 1
        column = np.cumsum(shared) - 1
        keep = shared[place]
        owner, place = owner[keep], column[place[keep]]
        common = np.zeros((n, n))
        width = 4096
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(place, [at, at + width])
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], place[a:b] - at] = 1
            common += m @ m.T
        union = np.maximum(sizes[:, None] + sizes[None, :] - common, 1)
        return new & (common >= threshold * union - _EPS), common / union


def _roots(linked: np.ndarray, nodes: list[int]) -> list[int]:
    """The smallest node of each one's component within the block."""
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b, key=lambda k: nodes[k])] = min(a, b, key=lambda k: nodes[k])
    return [nodes[find(i)] for i in range(len(nodes))]


def _verify(threshold: float, trees: int, lengths: list[int], level: int):
    def done(rows: list[dict]):
        linked, similar_ = _Group(rows, trees).links(threshold, level)
        nodes, counts = [r["node"] for r in rows], linked.sum(axis=1)
        roots = _roots(linked, nodes) if counts.any() else nodes
        # For each length, how many pairs like those found have met nowhere.
        chance = [missed(np.where(linked, similar_, 1.0), d, trees) for d in lengths] if counts.any() else []
        lost = [(m / (1 - m)).sum(axis=1) for m in chance]
        at = np.nonzero(counts)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in at], pa.int64()), pa.array(counts[at], pa.int64()), pa.array([roots[i] for i in at], pa.int64()), pa.array([[float(x[i]) for x in lost] for i in at], pa.list_(pa.float64()))], names=["node", "links", "root", "lost"]
        )

    def run(batches):
        # Rows are sorted by block: one block is held at a time.
        rows, at = [], None
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1) if len(batch) else ()
            for r, k in zip(batch.drop_columns(["keys"]).to_pylist(), keys, strict=True):
                now = (r["key"], r["lo"], r["hi"])
                if now != at and rows:
                    yield done(rows)
                    rows = []
                at = now
                rows.append(r | {"keys": k})
        if rows:
            yield done(rows)

    return run


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, label): the smallest node connected with each node of ``edges`` (a, b).

    Alternates large stars and small stars; the number of rounds grows with the
    logarithm of the longest path. Only minima and counts are aggregated.
    """
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", nodes)
    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # The centre of a star has as many rows as neighbours: such nodes are few, and go by broadcast.
        large = join_back(both.filter("b > a"), least, "a", "n", max(HOT_ROWS, now[0] // HOT_SHARE)).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m", "a")
        edges = stage_table(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges", now[0])
        # Done when a round changes nothing: every node then hangs on a root that hangs on none.
        before, now = now, mark(edges)
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, longest: int = MAX_DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, sha (of the text), class_id, n_links, n_copies, kept.

    Words are runs of letters, digits and underscores in lower case; a text is
    the set of its n-grams of ``words`` words, or of all its words if it has
    fewer. Two texts are linked when the Jaccard similarity of their sets is
    ``threshold`` or more. class_id is the smallest doc_id among all rows that
    links and copies connect; n_links the number of other word sequences linked
    to the row's own; n_copies the number of rows with its word sequence. kept
    is true for the row of the smallest (doc_id, sha) of its class; rows that
    share both are one document and stay or go together. Texts without a word
    (nulls, too) are linked to nothing and stay. Extra columns are ignored; an
    empty table gives no rows.
    """
    lengths = depths(threshold, trees, longest, recall)
    rows = stage_table(_signed(docs, doc_id, text, words, trees, lengths), "signed")
    total = rows.count()
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "sha")).alias("first"), F.count("*").alias("n_copies"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    reps = stage_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes", total)

    links, edges = _links(docs, doc_id, text, reps, total, words, threshold, trees, lengths, block)
    labels = components(edges, total)
    links = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = reps.select("node", "digest", "first", "n_copies").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = stage_table(known.drop("node"), "labelled", total)
    heads = known.groupBy("label").agg(F.min("first").alias("head"), F.count("*").alias("texts"))
    hot = max(HOT_ROWS, total // HOT_SHARE)
    settled = stage_table(join_back(known, heads, "label", "texts", hot).select("digest", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "settled", total)
    joined = join_back(rows.filter("digest is not null").select("doc_id", "sha", "digest"), settled, "digest", "n_copies", hot)
    own = F.struct("doc_id", "sha")
    linked = joined.select("doc_id", "sha", F.col("head.doc_id").alias("class_id"), "n_links", "n_copies", own.eqNullSafe(F.col("head")).alias("kept"))
    blank = rows.filter("digest is null").select("doc_id", "sha", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return linked.unionByName(blank)


def _links(docs: DataFrame, doc_id: str, text: str, reps: DataFrame, total: int, words: int, threshold: float, trees: int, lengths: list[int], block: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) to be summed up, and (a, b) edges that connect what is linked."""
    # Classes that meet no other even at the shortest prefixes take no further part.
    shortest = _at(reps, trees, len(lengths) - 1).select("node", "key")
    met = shortest.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    wanted = stage_table(shortest.join(met, "key").select("node").distinct().join(reps, "node").select("node", "keys", "size", F.col("first.doc_id").alias("id"), F.col("first.sha").alias("sha")), "wanted", total)
    sets = _sets(docs, doc_id, text, wanted.select("node", "id", "sha"), words)
    balls = _balls(wanted, sets, trees, threshold, total)
    core = (2 * F.col("rho") <= F.col("most") + _EPS).alias("core")
    wanted = stage_table(wanted.select("node", "keys", "size").join(balls, "node", "left").select("*", F.coalesce(core, F.lit(False)).alias("core")), "placed", total)

    links, edges, found, lost = [_sure_links(balls, total)], [balls.select(F.col("node").alias("a"), F.col("ball").alias("b"))], 0, [0.0] * len(lengths)
    for level, depth in enumerate(lengths):
        below = _at(wanted, trees, level, "size", "ball", "core")
        members = stage_table(_members(below, level == 0, block, total), "members", trees * total)
        own = wanted.select("node", "keys", "ball", "rho", "most").join(sets, "node")
        blocks = members.join(own, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        done = stage_table(bounded_batches(blocks.select("key", "lo", "hi", "tree", "block", "node", "keys", "ball", "rho", "most", "set")).mapInArrow(_verify(threshold, trees, lengths, level), "node bigint, links bigint, root bigint, lost array<double>"), "verified")
        links.append(done.select("node", "links"))
        edges.append(done.select(F.col("node").alias("a"), F.col("root").alias("b")))
        sums = done.agg(F.coalesce(F.sum("links"), F.lit(0)), *(F.coalesce(F.sum(F.get("lost", F.lit(k))), F.lit(0.0)) for k in range(len(lengths)))).first()
        found, lost = found + sums[0] / 2, [a + b / 2 for a, b in zip(lost, sums[1:], strict=True)]
        if lost[level] + missed(threshold, depth, trees) <= LOST * found:
            break
    return reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, edges)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``similar`` keeps, with all their columns."""
    key, sha, own = fresh(docs, "id"), fresh(docs, "sha"), fresh(docs, "own")
    gone = stage_table(similar(docs, doc_id, text, **settings).filter("not kept").select(F.col("doc_id").alias(key), F.col("sha").alias(sha)).distinct(), "gone")
    near = checked_broadcast(gone, gone.count(), BROADCAST_KEYS)
    return docs.withColumn(own, _sha(text)).join(near, (F.col(own) == F.col(sha)) & col(doc_id).eqNullSafe(F.col(key)), "left_anti").drop(own)


#: The same rows by all pairs that share a shingle; for tables with unique doc_ids.
OP10_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
texts AS (SELECT w, min(doc_id) AS rep, count(*) AS n_copies FROM t WHERE len(w) > 0 GROUP BY w),
sets AS (
  SELECT rep, list_distinct(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM texts
),
grams AS (SELECT rep, unnest(s) AS gram FROM sets),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON a = x.rep JOIN sets y ON b = y.rep WHERE c >= {THRESHOLD}::DOUBLE * (len(x.s) + len(y.s) - c) - 1e-9),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
class AS (SELECT a AS rep, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a AS rep, count(*) AS n_links FROM edges GROUP BY a),
known AS (SELECT w, n_copies, coalesce(n_links, 0) AS n_links, least(rep, coalesce(least, rep)) AS class_id FROM texts LEFT JOIN class USING (rep) LEFT JOIN counts USING (rep))
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies, doc_id = coalesce(class_id, doc_id) AS kept FROM t LEFT JOIN known USING (w)
"""
