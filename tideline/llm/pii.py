"""Format-preserving Feistel pseudonyms for personal data.

Values are found by format and validated (check digits, number ranges, calendar); then they are permuted within
their format by a keyed Feistel network with cycle walking, so that a pseudonym is valid again, equal values
get equal pseudonyms in every document, and the holder of the key can undo them (``restore``).

Kinds: ``card`` (13 to 19 digits, Luhn), ``iban`` (mod 97), ``ssn`` (issued ranges), ``phone`` (North American
plan; or + and 8 to 15 digits), ``ip`` (four octets), ``date`` (years 1900 to 2099, three notations), ``email``
(letters and digits of the local part), ``secret`` (key ids, and values named password, token, secret, key).
Separators and letter case stay. Text that fails validation stays.

Where values of two kinds overlap, the kind that is listed first in ``KINDS`` takes the place. Null texts stay null with
no spans; empty and long texts are treated whole. Rows that repeat a document get equal results. Further columns are carried, but for any named n_found, kinds or spans. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import arrow_by_bytes, shielded, slices

#: Production passes its own key; this one only keeps reruns of the registered query equal.
DEMO_KEY = b"tideline demonstration key"
ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n - 1, separate for every label."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.key, self.label = n, blake2b(key, digest_size=32).digest(), label.encode()
        self.half = max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1

    def _f(self, round_: int, x: int) -> int:
        size = -(-self.half // 8)
        data = self.label + b"|" + bytes([round_]) + x.to_bytes(size, "big")
        return int.from_bytes(blake2b(data, key=self.key, digest_size=max(8, min(64, size))).digest(), "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for r in rounds:
                left, right = right, left ^ self._f(r, right)
            x = (right << self.half) | left  # the swap makes the same network, in reverse order, its inverse
            if x < self.n:
                return x

    def encrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def decrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


@lru_cache(maxsize=1024)
def _feistel(key: bytes, label: str, n: int) -> Feistel:
    return Feistel(key, label, n)


def _permute(key: bytes, label: str, x: int, n: int, back: bool) -> int:
    f = _feistel(key, label, n)
    return f.decrypt(x) if back else f.encrypt(x)


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn(digits) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    head = str(_permute(key, f"card{n}", int(digits[:-1]), 10**n, back)).zfill(n)
    return _fill(m[0], head + str((10 - luhn(head + "0")) % 10))


_RADIX = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _class(c: str) -> str:
    return "0" if c in _RADIX["0"] else "a" if c in _RADIX["a"] else "A" if c in _RADIX["A"] else ""


def permute_characters(text: str, key: bytes, label: str, back: bool = False) -> str:
    """Digits, lower-case and upper-case ASCII letters are permuted among themselves, as one mixed-radix number;
    all else stays. Lengths and places of the classes are kept."""
    value, size, pattern = 0, 1, "".join(map(_class, text))
    for c in text:
        if k := _class(c):
            value, size = value * len(_RADIX[k]) + _RADIX[k].index(c), size * len(_RADIX[k])
    if size == 1:
        return text
    value = _permute(key, f"{label}:{pattern}", value, size, back)
    out = []
    for c in reversed(text):
        if k := _class(c):
            value, d = divmod(value, len(_RADIX[k]))
            c = _RADIX[k][d]
        out.append(c)
    return "".join(reversed(out))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permute_characters(plain[4:], key, f"iban{plain[:2]}", back)
    new = f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ranged(values: list[int], lows: list[int], sizes: list[int], key: bytes, label: str, back: bool) -> list[int]:
    """Numbers within ranges, permuted together."""
    x, n = 0, 1
    for v, low, size in zip(values, lows, sizes, strict=True):
        x, n = x * size + v - low, n * size
    x = _permute(key, label, x, n, back)
    out = []
    for low, size in zip(reversed(lows), reversed(sizes), strict=True):
        x, d = divmod(x, size)
        out.append(d + low)
    return out[::-1]


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = int(m[0][:3]), int(m[0][4:6]), int(m[0][7:])
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    a, g, s = _ranged([area - (area > 666), group, serial], [1, 1, 1], [898, 99, 9999], key, "ssn", back)
    return f"{a + (a >= 666):03d}-{g:02d}-{s:04d}"


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    national = digits[-10:]
    if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":
        if national[0] < "2" or national[3] < "2":
            return None
        new = _ranged([int(national[:3]), int(national[3:6]), int(national[6:])], [200, 200, 0], [800, 800, 10000], key, "phone", back)
        return _fill(m[0], digits[:-10] + "{:03d}{:03d}{:04d}".format(*new))
    if not m[0].startswith("+") or not 8 <= len(digits) <= 15:
        return None
    return _fill(m[0], digits[:2] + str(_permute(key, f"phone{digits[:2]}", int(digits[2:]), 10 ** (len(digits) - 2), back)).zfill(len(digits) - 2))


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    return ".".join(map(str, _ranged(octets, [0] * 4, [256] * 4, key, "ip", back)))


_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    text = m[0]
    parts = [int(x) for x in re.split(r"\D", text)]
    y, mo, d = parts if len(re.match(r"\d+", text)[0]) == 4 else (parts[2], parts[0], parts[1]) if "/" in text else parts[::-1]
    try:
        day = (date(y, mo, d) - _FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = _FIRST_DAY + timedelta(_permute(key, "date", day, _DAYS, back))
    if "-" in text:
        return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"
    return f"{new.month:02d}/{new.day:02d}/{new.year:04d}" if "/" in text else f"{new.day:02d}.{new.month:02d}.{new.year:04d}"


def _email(m: re.Match, key: bytes, back: bool) -> str:
    local, _, domain = m[0].partition("@")
    return f"{permute_characters(local, key, 'email', back)}@{domain}"


def _secret(m: re.Match, key: bytes, back: bool) -> str:
    at = m.start("value") - m.start() if m["value"] else 0
    if not at:
        return m[0][:4] + permute_characters(m[0][4:], key, "keyid", back)
    stop = m.end("value") - m.start()
    return m[0][:at] + permute_characters(m["value"], key, "secret", back) + m[0][stop:]


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    pseudonym: Callable[[re.Match, bytes, bool], str | None]


#: In order of precedence: what one kind has taken, later ones leave.
KINDS = (
    Kind("secret", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_+/.-]{8,})"), _secret),
    Kind("email", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), _email),
    Kind("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    Kind("card", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w|\.\d)"), _card),
    Kind("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _ip),
    Kind("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    Kind("date", re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"), _date),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-)|(?<![\w.+-])\+\d(?:[ .-]?\d){7,14}(?!\w|-)"), _phone),
)
_HINT = re.compile(r"[0-9@=:]")


_LOCAL = frozenset(_RADIX["0"] + _RADIX["a"] + _RADIX["A"] + "._%+-")


def _emails(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Addresses, found from their ``@`` to the left: a search from the left would read a long run of characters that
    an address may begin with once for each of them. An address begins after none of letters, digits, ``_``, ``.``, ``+``, ``-``."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        low = sign
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        begins = [low] if low == 0 or not (text[low - 1].isalnum() or text[low - 1] in "_.+-") else []
        begins += [i + 1 for i in range(low, sign) if text[i] == "%"]
        start = next((i for i in begins if _class(text[i]) and i < sign), None)
        m = pattern.match(text, start) if start is not None else None
        if m:
            yield m
            done = m.end()
        else:
            done = sign + 1
        sign = text.find("@", max(done, sign + 1))


def find(text: str, key: bytes, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of all values, in order of place. Time grows with the text's length."""
    if not _HINT.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []  # in order of place, no two overlap
    for kind in KINDS:
        found = []
        for m in _emails(kind.pattern, text) if kind.name == "email" else kind.pattern.finditer(text):
            at = bisect_left(taken, (m.end(),))
            if not at or taken[at - 1][1] <= m.start():
                new = kind.pseudonym(m, key, back)
                if new is not None:
                    found.append((m.start(), m.end(), kind.name, new))
        if found:
            taken = sorted(taken + found)
    return [(name, start, end, new) for start, end, name, new in taken]


def replaced(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def restore(text: str, key: bytes) -> str:
    """Undo the pseudonyms of a text."""
    return replaced(text, find(text, key, back=True))


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, plus n_found (int), kinds (such as ``card:1,email:2``) and spans (array
    of kind, start, end in code points of the text that came)."""
    arrow_by_bytes(docs.sparkSession)
    own, names_back = shielded(docs, ("text",))
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts, n, kinds, spans = [], [], [], []
            for text in batch.column(at).to_pylist():
                found = find(text, key) if text else []
                texts.append(replaced(text, found) if found else text)
                n.append(len(found))
                kinds.append(",".join(f"{k}:{c}" for k, c in sorted(Counter(x[0] for x in found).items())))
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found])
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(kinds, pa.string()), pa.array(spans, schema)],
                                             [*batch.schema.names, "n_found", "kinds", "spans"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    out = own.mapInArrow(run, f"{types}, n_found int, kinds string, spans array<struct<kind:string,start:int,end:int>>")
    return names_back(out, "n_found", "kinds", "spans")
