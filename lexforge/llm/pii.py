"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validation are permuted inside their
format by a keyed Feistel network: a card number turns into another valid card
number, a date into another date, an address into another address. The
permutation depends on the key and the kind alone, so equal values (however
they are spaced, and dates in whatever order) get equal pseudonyms in every
document and every run, and no table of values is kept or shuffled.

Domains of up to 2^64 places are permuted as numbers. Longer strings (an address
may have any length) are permuted as two halves of letters, each moved by a key
stream that the other one starts, so that the time is linear in their length.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lexforge.runtime import bounded_batches, col, map_arrow

ROUNDS = 8


class Feistel:
    """Keyed permutations of finite domains."""

    def __init__(self, key: bytes):
        self._key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, kind: str, turn: int, half: int, size: int) -> int:
        said = f"{kind}:{turn}:{half}:{size}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self._key, digest_size=32).digest(), "big") % size

    def _there(self, x: int, a: int, b: int, kind: str) -> int:
        left, right = divmod(x, b)
        for turn in range(0, ROUNDS, 2):
            left = (left + self._mix(kind, turn, right, a)) % a
            right = (right + self._mix(kind, turn + 1, left, b)) % b
        return left * b + right

    def _back(self, y: int, a: int, b: int, kind: str) -> int:
        left, right = divmod(y, b)
        for turn in range(ROUNDS - 2, -1, -2):
            right = (right - self._mix(kind, turn + 1, left, b)) % b
            left = (left - self._mix(kind, turn, right, a)) % a
        return left * b + right

    def permute(self, x: int, size: int, kind: str, valid: Callable[[int], bool] | None = None) -> int:
        """Another place than ``x`` in range(size), among the valid ones; ``x`` only if it is the only one.

        The network orders a rectangle that covers the domain; from ``x`` the
        next place in that order is taken, and the next while it is outside.
        All places form one cycle, so the result is a permutation that leaves
        nothing in its place.
        """
        a = math.isqrt(max(size - 1, 0)) + 1
        b = max(-(-size // a), 1)
        at = self._there(x, a, b, kind)
        while True:
            at = (at + 1) % (a * b)
            y = self._back(at, a, b, kind)
            if y < size and (valid is None or valid(y)):
                return y

    def spell(self, text: str, alphabet: str, kind: str) -> str:
        """Permute a string over an alphabet, keeping its length; only a string without letters stays."""
        place, size, kind = {c: i for i, c in enumerate(alphabet)}, len(alphabet), f"{kind}{len(text)}"
        # A power is compared by logarithms, so that it is not made for a long text.
        if len(text) * math.log2(size) > 64:
            return "".join(map(alphabet.__getitem__, self._long(np.array([place[c] for c in text], np.int64), size, kind).tolist()))
        n, out = 0, []
        for c in text:
            n = n * size + place[c]
        n = self.permute(n, size ** len(text), kind)
        for _ in text:
            n, i = divmod(n, size)
            out.append(alphabet[i])
        return "".join(reversed(out))

    def _stream(self, kind: str, turn: int, half: np.ndarray, size: int, n: int) -> np.ndarray:
        """``n`` letters that depend on the key and on all letters of ``half``."""
        said = hashlib.blake2b(half.astype(np.uint8).tobytes(), key=self._key, person=b"half", digest_size=32).digest()
        return np.frombuffer(hashlib.shake_256(self._key + f"{kind}:{turn}:".encode() + said).digest(4 * n), "<u4").astype(np.int64) % size

    def _long(self, letters: np.ndarray, size: int, kind: str) -> np.ndarray:
        """As ``permute``: the next string in the order of the network, all of which form one cycle."""
        left, right = letters[: len(letters) // 2].copy(), letters[len(letters) // 2 :].copy()
        for turn in range(0, ROUNDS, 2):
            left = (left + self._stream(kind, turn, right, size, len(left))) % size
            right = (right + self._stream(kind, turn + 1, left, size, len(right))) % size
        # The next one: the trailing last letters start over, and the one before them moves on.
        both = np.concatenate([left, right])
        low = np.nonzero(both != size - 1)[0]
        at = int(low[-1]) if len(low) else -1
        both[at + 1 :] = 0
        if at >= 0:
            both[at] += 1
        left, right = both[: len(left)], both[len(left) :]
        for turn in range(ROUNDS - 2, -1, -2):
            right = (right - self._stream(kind, turn + 1, left, size, len(right))) % size
            left = (left - self._stream(kind, turn, right, size, len(left))) % size
        return np.concatenate([left, right])


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_rest(country: str, body: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in (body + country + check).upper())) % 97


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(f: Feistel, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = f.spell(digits[:-1], DIGITS, "card")
    return _refill(m[0], body + luhn_digit(body))


def _iban(f: Feistel, m: re.Match) -> str | None:
    plain = re.sub(r"\s", "", m[0])
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_rest(country, body, check) != 1:
        return None
    return _refill(m[0], country + _filled(f, body, body, "iban", lambda b: f"{98 - _iban_rest(country, b, '00'):02d}"))


def _filled(f: Feistel, shape: str, body: str, kind: str, check: Callable[[str], str]) -> str:
    """Digits among themselves, letters among themselves, with the check characters in front."""
    new = f.spell("".join(c for c in body if c.isdigit()), DIGITS, kind)
    letters = f.spell("".join(c for c in body if c.isalpha()).lower(), LETTERS, kind + "a").upper()
    d, a = iter(new), iter(letters)
    made = "".join(next(d) if c.isdigit() else next(a) for c in shape)
    return check(made) + made


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, m: re.Match) -> str | None:
    n = int(m[0].replace("-", ""))
    return _refill(m[0], f"{f.permute(n, 10**9, 'ssn', _ssn_ok):09d}") if _ssn_ok(n) else None


def _phone(f: Feistel, m: re.Match) -> str | None:
    # The country code and a trunk zero in brackets stay; what is left is the same digits in every notation.
    shape = _TRUNK.sub(lambda x: "\0" * len(x[0]), m[0]) if m[0][0] == "+" else m[0]
    digits = re.sub(r"\D", "", shape)
    country = _COUNTRY.match(digits)[0] if m[0][0] == "+" else ""
    number = digits[len(country) :]
    if len(digits) > 15 or len(number) < 6 and len(digits) < 8 or not number:
        return None
    new = _refill(shape, country + f.spell(number, DIGITS, "phone"))
    return "".join(a if b == "\0" else b for a, b in zip(m[0], new, strict=True))


def _ip(f: Feistel, m: re.Match) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    n = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(f: Feistel, m: re.Match) -> str | None:
    a, b, c = (int(x) for x in re.split(r"\D", m[0]))
    orders = [(a, b, c)] if m[0][4:5] in ("-", "/", ".") else [(c, b, a), (c, a, b)]
    for k, (year, month, day) in enumerate(orders):
        try:
            old = dt.date(year, month, day).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= old <= LAST_DAY:
            return None
        # Days above 12 among themselves in every notation: month-first dates with others would be read back as day-first ones.
        swaps, late = k == 1, day > 12
        ok = lambda n: (dt.date.fromordinal(n + FIRST_DAY).day > 12) == late  # noqa: E731, B023
        new = dt.date.fromordinal(f.permute(old - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", ok) + FIRST_DAY)
        sep = re.sub(r"\d", "", m[0])[0]
        # Where one digit stood for a day or month, none is padded.
        width = 1 if re.search(r"(?<!\d)\d(?!\d)", m[0]) else 2
        day_, month_ = f"{new.day:0{width}d}", f"{new.month:0{width}d}"
        if len(orders) == 1:
            return sep.join((f"{new.year:04d}", month_, day_))
        return sep.join((month_, day_, f"{new.year:04d}") if swaps else (day_, month_, f"{new.year:04d}"))
    return None


def _email(f: Feistel, m: re.Match) -> str | None:
    local, _, host = m[0].rpartition("@")
    name, _, top = host.rpartition(".")
    body = f"{local}@{name}".lower()
    letters = iter(f.spell("".join(c for c in body if "a" <= c <= "z"), LETTERS, "email"))
    digits = iter(f.spell("".join(c for c in body if c in DIGITS), DIGITS, "email-digits"))
    made = (next(letters) if "a" <= c <= "z" else next(digits) if c in DIGITS else c for c in body)
    return "".join(new.upper() if old.isupper() else new for old, new in zip(f"{local}@{name}", made, strict=True)) + "." + top


_NUMBERS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))(?![A-Za-z0-9])"
    r"|(?P<card>\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])"
    r"|(?P<date>(?:19|20)\d\d(?P<d1>[-/.])[01]?\d(?P=d1)[0-3]?\d|[0-3]?\d(?P<d2>[-/.])[0-3]?\d(?P=d2)(?:19|20)\d\d)(?![0-9])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![0-9])"
    r"|(?P<ip>(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?[0-9])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}[ .-](?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,8}){1,3}|\+\d{8,15}|0\d{1,4}[ /-]\d{6,8})(?![A-Za-z0-9])"
    r")"
)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
#: Country codes of telephone numbers (ITU-T E.164): none is the beginning of another, and those not listed have three digits.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
_TRUNK = re.compile(r"(?<=[0-9 .-])\(0\)")
_DIGIT = re.compile(r"[0-9]")
_KINDS = {"iban": _iban, "card": _card, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone}


class Pseudonymizer:
    def __init__(self, key: bytes):
        self._f = Feistel(key)

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, pseudonym) of what is found, by start."""
        emails = [("email", m.start(), m.end(), _email(self._f, m)) for m in _EMAIL.finditer(text)] if "@" in text else []
        out, k = [], 0
        at = _DIGIT.search(text)
        m = _NUMBERS.search(text, max(at.start() - 6, 0)) if at else None
        while m:
            kind = next(k for k in _KINDS if m[k] is not None)
            new = _KINDS[kind](self._f, m)
            while k < len(emails) and emails[k][2] <= m.start():
                k += 1
            if new is not None and not (k < len(emails) and emails[k][1] < m.end()):
                out.append((kind, m.start(), m.end(), new))
            m = _NUMBERS.search(text, m.start() + 1 if new is None else m.end())
        return sorted(out + emails, key=lambda x: x[1])

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        found, parts, at = self.spans(text), [], 0
        for _, start, end, new in found:
            parts += [text[at:start], new]
            at = end
        return ("".join([*parts, text[at:]]) if found else text), found


@lru_cache(maxsize=4)
def pseudonymizer(key: bytes) -> Pseudonymizer:
    return Pseudonymizer(key)


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and n_pii (long) and pii_spans (kind:start:end of the old text, by start).

    Finds e-mail addresses, and what passes its validation of: payment cards
    (check digit), IBANs (check digits), IPv4 addresses, social security
    numbers, telephone numbers and calendar dates (1900 to 2099). A number that
    fails is left alone. A null text stays null with n_pii 0 and no spans. Every
    row is treated on its own, so repeated rows and empty tables need no rule.
    Columns already named n_pii or pii_spans are replaced.
    """
    made = {"n_pii", "pii_spans"}
    kept = [c for c in docs.columns if c.lower() not in made]
    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("n_pii bigint, pii_spans string").fields])
    at = kept.index(docs.select(col(text)).columns[0])

    def run(batches):
        p = pseudonymizer(key)
        for batch in batches:
            texts, counts, spans = [], [], []
            for v in batch.column(at):
                x = v.as_py()
                new, found = p.replace(x) if x else (x, [])
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
            arrays = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=[*kept, "n_pii", "pii_spans"])

    return map_arrow(bounded_batches(docs.select(*map(col, kept))), run, schema)
