"""Byte-level BPE by longest matches and backtracking, and its inverse.

Bytes map one to one onto the characters U+0000 to U+00FF, so that an
Aho-Corasick automaton over strings finds every vocabulary entry inside a
pre-token in one pass. The encoder takes the longest entry at each place. Two
adjacent entries are compatible when merging their joined bytes in rank order
would leave exactly these two; that test unwinds merges and is memoised. An
entry that is incompatible with its left neighbour gives way to the next
shorter one, and when none is left the left neighbour is taken back. A place
found to be a dead end is never entered again, so the work is linear in the
length of the pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexforge.runtime import bounded_batches, col

#: Pre-tokens held in a worker's cache; a full cache is emptied.
CACHE_WORDS = 1 << 18
#: Pre-tokens with more characters are not cached.
CACHE_CHARS = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encode and decode by a rank file; the ids equal those of merging in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._joined: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._auto = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) != 2:
                    continue  # no sequence of merges ends in it; only a whole pre-token can be it
                self._halves[rank] = (parts[0], parts[1])
                self._joined[parts[0], parts[1]] = rank
            else:
                self._halves[rank] = (rank, rank)
            self._auto.add_word(token.decode("latin-1"), (rank, len(token)))
        self._auto.make_automaton()

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Ids after merging the bytes of ``piece`` by all ranks under ``below``."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two entries stay apart when their joined bytes are merged."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 1 << 20:
                self._fits.clear()
            known = self._fits[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the younger merge on either side of the seam until both sides are bytes.

        At each step the entries that touch the seam existed together; had their
        pair a merge older than the one just undone, it would have come first.
        """
        joined, halves, undone = self._joined, self._halves, 1 << 62
        while True:
            if joined.get((left, right), undone) < undone:
                return False
            left_half, right_half = halves[left][1], halves[right][0]
            left_whole, right_whole = left_half == left, right_half == right
            if left_whole and right_whole:
                return True
            # On equal ranks the leftmost merge comes first, so the right one is the younger.
            if right_whole or (not left_whole and left > right):
                undone, left = left, left_half
            else:
                undone, right = right + 1, right_half

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, length) in self._auto.iter(piece.decode("latin-1")):
            starts[end - length + 1].append((length, rank))  # shorter ends come first
        dead = bytearray(n + 1)
        ids: list[int] = []
        places: list[tuple[int, int]] = []  # where each id begins, and the next choice there
        at, choice = 0, len(starts[0]) - 1
        compatible = self.compatible
        while at < n:
            options, taken = starts[at], False
            while choice >= 0:
                length, rank = options[choice]
                choice -= 1
                if not dead[at + length] and (not ids or compatible(ids[-1], rank)):
                    ids.append(rank)
                    places.append((at, choice))
                    at += length
                    choice = len(starts[at]) - 1 if at < n else -1
                    taken = True
                    break
            if not taken:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                ids.pop()
                at, choice = places.pop()
        return ids


#: Texts without a character from here on are split by the faster engine.
NARROW = 0x250


class PreTokenizer:
    """All matches of a pattern, each on its own.

    Most texts have characters below ``NARROW`` only. For them the pattern's
    property classes become plain ranges, taken from the engine that knows the
    properties, and the standard library finds the same matches in less time.
    """

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern).findall
        below = "".join(map(chr, range(NARROW)))

        def ranges(m: re.Match) -> str:
            runs = (x[0] for x in regex.finditer(f"(?:{m[0]})+", below))
            return "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x in runs)

        inside = re.sub(r"\[[^]]*\]", lambda m: re.sub(r"\\p\{\w+\}|\\s", ranges, m[0]), pattern)
        plain = re.sub(r"\\p\{\w+\}|\\s", lambda m: f"[{ranges(m)}]", inside)
        plain = plain.replace(r"\S", f"[^{ranges(re.match('.*', chr(92) + 's'))}]")
        self._narrow = None if re.search(r"\\[PXd]|\\p|&&|\|\|", plain) else re.compile(plain).findall
        self._wide = re.compile(f"[{chr(NARROW)}-{chr(0x10FFFF)}]").search

    def findall(self, text: str) -> list[str]:
        return self._any(text) if self._narrow is None or self._wide(text) else self._narrow(text)


class WordCache(dict):
    """Results by word, bounded: a full cache is emptied, long words are computed each time."""

    def __init__(self, compute, words: int = CACHE_WORDS, chars: int = CACHE_CHARS):
        super().__init__()
        self._compute, self._words, self._chars = compute, words, chars

    def __missing__(self, word):
        made = self._compute(word)
        if len(word) <= self._chars:
            if len(self) >= self._words:
                self.clear()
            self[word] = made
        return made


class TextCodec:
    """Whole texts: pre-tokens by a pattern, ids by ``BytePairEncoder``."""

    def __init__(self, ranks_path: str, pattern: str):
        self.bpe = bpe = BytePairEncoder(load_ranks(ranks_path))
        self._find = PreTokenizer(pattern).findall
        self._ids = WordCache(lambda word: tuple(bpe.encode_piece(word.encode("utf-8")))).__getitem__
        self._text_of = {i: str(i) for i in bpe.bytes_of}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._ids, self._find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids))

    def digest_ids(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self._text_of.__getitem__, ids)).encode()).hexdigest()


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> TextCodec:
    """One codec for each worker process and vocabulary."""
    return TextCodec(ranks_path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of each whole text.

    Null texts count as empty and give an empty array. Other columns pass
    through unchanged; a column that is already named ``ids`` is replaced.
    Repeated rows each get their result; an empty table stays empty.
    """
    return _by_row(docs, text, {ids: "array<int>"}, lambda c, x: (c.encode(x),), ranks_path, pattern)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a binary column ``text``: the bytes of each id sequence. Null or empty ids give empty bytes."""
    return _by_row(rows, ids, {text: "binary"}, lambda c, x: (c.decode(x or []),), ranks_path, pattern)


def _digests(c: TextCodec, text: str) -> tuple[int, str, str]:
    ids = c.encode(text)
    return len(ids), c.digest_ids(ids), hashlib.sha256(c.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens and the digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass; no ids leave the worker. Nulls, repeated
    rows and empty tables as in ``encode_texts``.
    """
    out = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return _by_row(docs, text, out, _digests, ranks_path, pattern, keep_input=False)


def _by_row(docs: DataFrame, source: str, made: dict[str, str], f, ranks_path: str, pattern: str, keep_input: bool = True) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    lower = {k.lower() for k in made}
    kept = [x for x in docs.columns if x.lower() not in lower and (keep_input or x != source)]
    cols = kept if source in kept else [*kept, source]
    fields = [docs.schema[x] for x in kept]
    made_schema = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in made.items()))
    types = [to_arrow_type(x.dataType) for x in made_schema]

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            blank = "" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else None
            outs: list[list] = [[] for _ in types]
            for v in values:
                x = v.as_py()
                for o, y in zip(outs, f(c, blank if x is None else x), strict=True):
                    o.append(y)
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(o, t) for o, t in zip(outs, types, strict=True))], names=[*kept, *made])

    return bounded_batches(docs.select(*map(col, cols))).mapInArrow(run, StructType([*fields, *made_schema.fields]))
