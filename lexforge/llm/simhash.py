"""SimHash near-dedup with fuzzy keys from the binary Golay code.

The Golay code of 23 bits is perfect: each word lies within three bits of exactly
one code word, so that decoding deals all words to 4096 indices. The decoded
indices of a word and of its 23 neighbours are one or six, and two words that
differ in two bits or fewer have one in common. A fingerprint of 64 bits is cut
into four segments of 16; a key is one segment, taken exactly, with one of the
indices of the 23 bits that follow it round the ring.

Pigeonhole: of three differing bits none lie in some segment. If the 23 bits
behind it hold all three, then the segment before it is free of them, too, and
is followed by two of them at most, or all three lie in the first seven bits
behind its successor; then the last of the four segments serves. So any two
fingerprints within three bits share a key, and what shares one is verified.

Equal fingerprints are merged first. A key with many fingerprints is never
listed pair by pair: what lies in it is keyed longer, again by the pigeonhole (of
the bits that are left, a quarter is free of differences), until few share a key
or all that share one are within three bits of each other, which are linked as a
star. Between these steps whatever is already connected is left out.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.llm.jaccard import components
from lexforge.runtime import bounded_batches, col, fresh, join_back, stage_table

#: Differing bits up to which two fingerprints are linked. The proof above is for this number.
DISTANCE = 3
#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Bits of a segment and of the word that is decoded.
SEGMENT, SPAN = 16, 23
#: Fixed value: the generator polynomial of the Golay code.
GENERATOR = 0xAE3
#: Fingerprints that share a key and are compared pair by pair.
MANY = 128
#: Fingerprints with more rows than both this and a HOT_SHARE-th of all rows are joined back by broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 10_000
#: Shingles of a text that are hashed at a time.
PIECE = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned number of 64 bits."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(found) - words + 1, 1)
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        spans = zip(begins[at : min(at + PIECE, n)].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[b:e], SEED) for b, e in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the low twelve bits and of the high eleven, and the error pattern of each syndrome."""
    bits, value = [], 1
    for _ in range(SPAN):
        bits.append(value)
        value <<= 1
        value = value ^ GENERATOR if value >> 11 else value
    low, high = (np.bitwise_xor.reduce([np.where(np.arange(1 << n) >> k & 1, b, 0) for k, b in enumerate(part)]) for n, part in ((12, bits[:12]), (11, bits[12:])))
    # The code is perfect: the patterns of three bits and fewer have all syndromes, each once.
    errors = np.zeros(1 << 11, np.int64)
    for i in range(SPAN + 1):
        for j in range(i + 1, SPAN + 1) if i < SPAN else (SPAN,):
            for k in range(j + 1, SPAN + 1) if j < SPAN else (SPAN,):
                pattern = sum(1 << x for x in (i, j, k) if x < SPAN)
                errors[low[pattern & 4095] ^ high[pattern >> 12]] = pattern
    return low, high, errors


def decoded(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the code word within three bits of each word."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 4095] ^ high[words >> 12]]) >> 11


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the different indices of each word and its neighbours."""
    near = np.stack([words, *(words ^ (1 << k) for k in range(SPAN))], axis=1)
    found = np.sort(decoded(near.ravel()).reshape(near.shape), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints: segment number, segment and index in one number."""
    rows, out = [], []
    for k in range(64 // SEGMENT):
        turned = prints << np.uint64(SEGMENT * k) | prints >> np.uint64((64 - SEGMENT * k) % 64) if k else prints
        segment = (turned >> np.uint64(64 - SEGMENT)).astype(np.int64)
        row, index = indices((turned >> np.uint64(64 - SEGMENT - SPAN)).astype(np.int64) & (1 << SPAN) - 1)
        rows.append(row)
        out.append((k << SEGMENT | segment[row]) << 12 | index)
    return np.concatenate(rows), np.concatenate(out)


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, f) of all fingerprints."""

    def run(batches):
        for batch in batches:
            f = np.asarray(batch.column(0), np.int64)
            for at in range(0, len(f), 4096):
                part = f[at : at + 4096]
                row, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "f"])

    return prints.select("f").mapInArrow(run, "key bigint, f bigint")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of fingerprints that share a key and are within the distance."""
    pair = rows.select("key", F.col("f").alias("a")).join(rows.select("key", F.col("f").alias("b")), "key")
    return pair.filter((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"))).select("a", "b")


def _pairs_across(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b) of those that are not connected yet: the fingerprints outside the largest label of a key against all others of it."""
    minor = rows.join(sizes.select("key", "major"), "key").filter("label <> major").select("key", F.col("f").alias("a"), F.col("label").alias("own"))
    pair = minor.join(rows.select("key", F.col("f").alias("b"), "label"), "key")
    return pair.filter((F.col("own") != F.col("label")) & _near(F.col("a"), F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _longer(rows: DataFrame, left: int) -> tuple[DataFrame, int]:
    """``rows`` (key, f, rest, ...) under longer keys: each fourth of the ``left`` bits of ``rest`` is added to the key in turn."""
    size = left // 4
    turns = []
    for k in range(4):
        low = left - size * (k + 1)
        taken = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low)
        turns.append(F.struct(F.concat("key", F.lit(f"/{k}:"), taken.cast("string")).alias("key"), above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1))).alias("rest")))
    return rows.withColumn("_turn", F.explode(F.array(*turns))).withColumn("key", F.col("_turn.key")).withColumn("rest", F.col("_turn.rest")).drop("_turn"), left - size


def edges_of(prints: DataFrame, many: int = MANY) -> DataFrame:
    """(a, b) edges between different fingerprints (column f) within the distance, that connect all that such links connect."""
    rows = _keyed(prints)
    sizes = stage_table(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    found = [stage_table(_pairs(rows.join(sizes.filter(F.col("n") <= many).select("key"), "key", "left_semi")).distinct(), "pairs")]
    hot = sizes.filter(F.col("n") > many).select("key")
    if hot.isEmpty():
        return found[0]
    # What is left of the bits behind the segment of a crowded key, in the order of the ring.
    kind = F.shiftrightunsigned("key", SEGMENT + 12)
    left = 64 - SEGMENT
    rest = F.coalesce(*(F.when(kind == k, _turned(F.col("f"), k)) for k in range(64 // SEGMENT))).bitwiseAND(F.lit((1 << left) - 1))
    crowd = stage_table(rows.join(hot, "key", "left_semi").select(F.col("key").cast("string").alias("key"), "f", rest.alias("rest")), "crowd")
    found.append(_chains(crowd.select("f").distinct()))
    while True:
        labels = components(reduce(DataFrame.unionByName, found)).select(F.col("node").alias("f"), "label")
        crowd = stage_table(crowd.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f")), "crowd")
        counts = crowd.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
        # A key whose fingerprints are all connected already has nothing to add.
        sizes = stage_table(counts.select("key", (F.col("n") - F.col("most.n")).alias("minor"), F.col("most.label").alias("major")).filter("minor > 0"), "sizes")
        few = sizes.filter(F.col("minor") <= many)
        found.append(stage_table(_pairs_across(crowd, few).distinct(), "pairs"))
        crowd = crowd.join(sizes.filter(F.col("minor") > many).select("key"), "key", "left_semi").drop("label")
        if left <= DISTANCE:
            # All that share a key are within the distance.
            least = crowd.groupBy("key").agg(F.min("f").alias("b"))
            found.append(stage_table(crowd.join(least, "key").filter("f > b").select(F.col("f").alias("a"), "b").distinct(), "stars"))
            break
        crowd, left = _longer(crowd, left)
        crowd = stage_table(crowd, "longer")
        if crowd.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _turned(f: Column, k: int) -> Column:
    """A fingerprint rotated so that its ``k``-th segment comes first."""
    return F.shiftleft(f, SEGMENT * k).bitwiseOR(F.shiftrightunsigned(f, 64 - SEGMENT * k)) if k else f


def _chains(prints: DataFrame) -> DataFrame:
    """(a, b): neighbours within the distance, when fingerprints are sorted from each of their segments on.

    True links that connect dense crowds at the cost of a few sorts; none is missed for good if it is not among them.
    """

    def run(batches):
        last = None
        for batch in batches:
            f = np.asarray(batch.column(0), np.int64)
            f = f if last is None else np.concatenate([[last], f])
            if not len(f):
                continue
            last = f[-1]
            near = np.bitwise_count((f[1:] ^ f[:-1]).view(np.uint64)) <= DISTANCE
            yield pa.RecordBatch.from_arrays([pa.array(f[1:][near]), pa.array(f[:-1][near])], names=["a", "b"])

    parts = []
    for k in range(64 // SEGMENT):
        turned = _turned(F.col("f"), k)
        parts.append(prints.select("f").repartitionByRange(turned).sortWithinPartitions(turned).mapInArrow(run, "a bigint, b bigint"))
    return stage_table(reduce(DataFrame.unionByName, parts).filter("a <> b"), "chains")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, many: int = MANY) -> DataFrame:
    """One row for each row of ``docs``: its key, fingerprint (16 hexadecimal digits) and component_id.

    Words are what stands between blanks, A to Z in lower case; a bit of the
    fingerprint is set if it is set in over half of the hashes of the text's
    shingles of ``words`` words, repeats included. A text with fewer words is
    one shingle, one without words (null, too) has fingerprint zero, which is
    linked like any other. component_id is the least key among all rows that
    links of three differing bits or fewer connect; null keys never are it, if
    there is another. Repeated rows stay rows; extra columns are ignored; an
    empty table gives no rows.
    """
    schema = StructType([docs.schema[key], *StructType.fromDDL("f bigint").fields])
    schema.fields[0].name = schema.names[0] = "id"

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(v.as_py(), words) for v in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "f"])

    rows = stage_table(bounded_batches(docs.select(col(key), col(text).cast("string").alias(fresh(docs, "text")))).mapInArrow(run, schema), "prints")
    prints = stage_table(rows.groupBy("f").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    labels = components(edges_of(prints, many)).select(F.col("node").alias("f"), "label")
    known = prints.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f"))
    hot = max(HOT_ROWS, rows.count() // HOT_SHARE)
    known = stage_table(known, "labelled")
    heads = known.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    placed = stage_table(join_back(known.select("f", "n", "label"), heads, "label", "prints", hot).select("f", "n", "component_id"), "placed")
    joined = join_back(rows, placed, "f", "n", hot)
    return joined.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
