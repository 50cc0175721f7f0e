"""Best-fit packing of token pieces into sequences of a fixed capacity.

Hierarchical residual packing. Each partition packs its own pieces best-fit,
longest first. Sequences that are nearly full are final. The others become
items themselves, as whole units of their fill, and are packed best-fit again
with those of neighbouring partitions, up a tree of fixed fan-in. What moves
between tasks is one short row for each unfinished sequence, never tokens.

A sequence that is more than half full can only take up one of at most half
the capacity, and best-fit leaves a partition no more than one of those. So a
node of the tree passes on, beside its small sequences, only as many possible
hosts of each fill as the tree has use for; the rest are final as they stand.
No piece is lost by that, and a node's memory is bounded by capacity x fan-in.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.tokenize import PreTokenizer, WordCache
from lexforge.runtime import BROADCAST_ROWS, bounded_batches, checked_broadcast, col, stage_table

CAPACITY = 1024
#: A sequence with no more free places than this is final.
NEARLY_FULL = 8
#: Nodes that meet in one node of the next level.
FAN_IN = 8
#: Pieces that a partition packs at once, so that its memory is bounded. What a window leaves underfull goes up the
#: tree like that of a partition; sequences that are only nearly full stay so, at most NEARLY_FULL / CAPACITY of the room.
WINDOW = 200_000


class BestFit:
    """Bins by what is free in them; the fullest bin that has room is found by the lowest set bit."""

    def __init__(self, capacity: int):
        self.capacity, self.fill = capacity, []
        self._by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._rooms = 0

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the place in it for an item."""
        fits = self._rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = self._by_room[room].pop()
            if not self._by_room[room]:
                self._rooms &= ~(1 << room)
        else:
            at, room = len(self.fill), self.capacity
            self.fill.append(0)
        place = self.fill[at]
        self.fill[at] += length
        if left := room - length:
            self._by_room[left].append(at)
            self._rooms |= 1 << left
        return at, place


def best_fit(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, place) of each item, longest first, and the fill of each bin."""
    bins, out = BestFit(capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        out[i] = bins.add(lengths[i])
    return out, bins.fill


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)] if n else []
    return [(s, (first if s == 0 else capacity)) for s in starts]


class TokenBytes:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian 32-bit words.

    As the library does, texts are first split at the file's added tokens, which
    stand for themselves; the file's byte-level pre-tokenizer then splits by
    ``pattern``. Splitting here lets a word be looked up, and only new words go
    through the model. A file with a normalizer, another pre-tokenizer or
    added tokens that take in their surroundings is refused.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before, added = said["pre_tokenizer"] or {}, said["added_tokens"]
        if said["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"added tokens that look at their surroundings: {path}")
        self._added = {t["content"]: t["id"].to_bytes(4, "little") for t in added if t["content"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split
        model = Tokenizer.from_file(path).model
        letters = sorted(ByteLevel.alphabet())
        plain = [c for c in letters if ord(c) < 256]
        moved = [c for c in letters if ord(c) >= 256]
        rest = [b for b in range(256) if chr(b) not in set(plain)]
        to_letter = {ord(c): c for c in plain} | dict(zip(rest, moved, strict=True))

        def ids(word: str) -> bytes:
            spelled = word.encode("utf-8").decode("latin-1").translate(to_letter)
            return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(spelled)])

        self._find, self._ids = PreTokenizer(pattern).findall, WordCache(ids).__getitem__

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            return b"".join([self._added[x] if x in self._added else self._plain(x) for x in self._split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._ids, self._find(text)))


@lru_cache(maxsize=4)
def token_bytes(path: str, pattern: str) -> TokenBytes:
    return TokenBytes(path, pattern)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and ``end_id``; only one that is longer than
    ``capacity`` is cut, into full pieces after a shorter first one. Null and
    empty texts are a document of ``end_id`` alone. Rows with a null or a
    repeated id are packed like any other; an empty table gives no rows. Extra
    columns are ignored. Sequence ids are any numbers; places are gapless.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint, fill bigint, open boolean"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tokens, made, held, key_type = token_bytes(tokenizer_path, pattern), 0, [], None
        base = TaskContext.get().partitionId() << 36

        def flush():
            nonlocal made
            places, fill = best_fit([h[3] for h in held], capacity)
            first = base + made
            made += len(fill)
            goes_on = still_open(fill, capacity, nearly_full, fan_in)
            key, piece, start, length, crc = (list(x) for x in zip(*held, strict=True))
            arrays = [pa.array(key, key_type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, [first + b for b, _ in places], [p for _, p in places], [fill[b] for b, _ in places]))]
            held.clear()
            return pa.RecordBatch.from_arrays([*arrays, pa.array([goes_on[b] for b, _ in places])], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill", "open"])

        for batch in batches:
            keys, key_type = batch.column(0), batch.column(0).type
            for key, value in zip(keys, batch.column(1), strict=True):
                blob = tokens(value.as_py() or "") + end
                key = key.as_py()
                for k, (s, n) in enumerate(cut(len(blob) // 4, capacity)):
                    held.append((key, k, s, n, zlib.crc32(blob[4 * s : 4 * (s + n)])))
                if len(held) >= window:
                    yield flush()
        if held:
            yield flush()

    pieces = stage_table(bounded_batches(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))).mapInArrow(run, schema), "pieces")
    moved = _merge_up(pieces, capacity, nearly_full, fan_in)
    n = moved.count()
    return (
        pieces.join(checked_broadcast(moved, n, 10 * BROADCAST_ROWS), "bin", "left")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))
    )


def still_open(fill: list[int], capacity: int, nearly_full: int, fan_in: int) -> list[bool]:
    """Which sequences the next level needs: the small ones, and ``fan_in`` hosts of each fill."""
    hosts, out = [0] * (capacity + 1), []
    for f in fill:
        wanted = f < capacity - nearly_full
        if wanted and 2 * f > capacity:
            hosts[f] += 1
            wanted = hosts[f] <= fan_in
        out.append(wanted)
    return out


def _merge_up(pieces: DataFrame, capacity: int, nearly_full: int, fan_in: int) -> DataFrame:
    """(bin, sequence, base) of each sequence that went into another one."""
    # Each sequence has one piece at place 0; that row stands for it.
    begun = pieces.filter((F.col("place") == 0) & F.col("open"))
    units = begun.select(F.shiftright("bin", 36).alias("node"), F.col("bin").alias("sequence"), "fill", "open", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"))
    top = pieces.agg(F.max(F.shiftright("bin", 36))).first()[0]
    schema = "node bigint, sequence bigint, fill bigint, open boolean, members array<struct<bin:bigint,base:bigint>>"
    final = []
    while top:
        top //= fan_in
        up = units.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInArrow(_merge_node(capacity, nearly_full, fan_in), schema)
        units = stage_table(up, "units", 64 * (top + 1) * fan_in)
        final.append(units.filter(~F.col("open")))
        units = units.filter("open")
    for x in final:
        units = units.unionByName(x)
    return units.filter(F.size("members") > 1).select("sequence", F.explode("members").alias("m")).select("m.bin", "sequence", "m.base")


def _merge_node(capacity: int, nearly_full: int, fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        units = sorted(table.to_pylist(), key=lambda r: (-r["fill"], r["sequence"]))
        places, fill = best_fit([r["fill"] for r in units], capacity)
        made: dict[int, dict] = {}
        for r, (b, place) in sorted(zip(units, places, strict=True), key=lambda x: x[1]):
            into = made.setdefault(b, {"node": r["node"], "sequence": r["sequence"], "fill": fill[b], "members": []})
            into["members"] += [{"bin": m["bin"], "base": m["base"] + place} for m in r["members"]]
        rows = list(made.values())
        goes_on = still_open([r["fill"] for r in rows], capacity, nearly_full, fan_in)
        return pa.Table.from_pylist([r | {"open": o} for r, o in zip(rows, goes_on, strict=True)], schema=_UNITS)

    return run


_UNITS = pa.schema([("node", pa.int64()), ("sequence", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_()), ("members", pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())])))])
