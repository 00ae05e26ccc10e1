"""Format-preserving pseudonyms: a keyed Feistel permutation within the format of each private value.

Values are found by pattern and validated (Luhn, IBAN remainder, octets, calendar, number plan) before they are replaced, so look-alikes
stay. A value is a number in a mixed-radix domain: digits stay digits, letters letters, fixed parts fixed. Two halves of that number take
turns adding a keyed hash of the other, which is a bijection on the domain; results that break the format's rules are permuted again
until one holds ("cycle walking", still a bijection). Long names and keys are vectors of characters, whose halves shift each other's characters. Hence one value has one pseudonym in every document, two values never share one,
and the pseudonym passes the same validation. Dates are permuted as day numbers, so one day stays linked across notations. Of two numbers before a year, ``/`` has the month first where
that is a date and the day first otherwise (``.`` always the day): 25/12/1980 is linked with 25.12.1980, but 03/04/1980 is March 4th, whatever its
writer meant. Days above 12 are permuted among themselves, so the pseudonym is read in the same order.

Kept in clear: the domain of a mail address, the country and first digits named below, separators. Cases: null text stays null, empty
text empty; text without a private value is unchanged, byte for byte. Overlaps: the leftmost match wins, then the order of ``KINDS``.
Rows are independent: repeated rows and null ids need no rule.
"""
from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import raw, slices

KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")
_PATTERN = re.compile(r"""
  (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
| (?P<secret>\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b
    |\b(?i:password|passwd|token|secret|api_?key)\s?[=:]\s?["']?[A-Za-z0-9_/+-]{6,})
| (?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?\b)
| (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
| (?P<date>(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])
    |(?<![0-9/])[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?![0-9/])
    |(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/]))
| (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
| (?P<phone>(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])
    |(?<![0-9+])\+[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9]{3,8}(?:[ -][0-9]{2,4})?(?![0-9])|(?<![0-9+])\+[0-9]{10,14}(?![0-9]))
| (?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ ][0-9]{4}[ ][0-9]{4}[ ][0-9]{1,7}|-[0-9]{4}-[0-9]{4}-[0-9]{1,7})|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))
""", re.X)
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049      # to 2099-12-31


@dataclass(frozen=True)
class PiiParams:
    """``key`` is the secret that the pseudonyms depend on, and has no default; ``rounds`` of the permutation (an even number). Strings of more than
    ``long`` characters are permuted character by character, which takes time in proportion to their length."""
    key: bytes
    rounds: int = 8
    kinds: tuple = KINDS
    long: int = 64

    def __post_init__(self):
        if not self.key:
            raise ValueError("pseudonyms need a secret key")


KEY = "spark.votelens.pii.key"
#: For trials on invented data only: whoever reads this can undo the pseudonyms.
DEMO_KEY = "not a secret: set spark.votelens.pii.key"


def session_params(spark: SparkSession) -> PiiParams:
    """Parameters with the key that the session names in ``spark.votelens.pii.key``; where it names none, the demonstration key, with a warning."""
    key = spark.conf.get(KEY, None)
    if not key:
        warnings.warn(f"{KEY} is not set: pseudonyms use the demonstration key", stacklevel=2)
    return PiiParams(key=(key or DEMO_KEY).encode())


def _drawn(of: str, n: int, p: PiiParams) -> bytes:
    """``n`` keyed pseudo-random bytes: hashes of a counter below a hash of ``of``."""
    seed = hashlib.blake2b(of.encode(), key=hashlib.blake2b(p.key).digest()).digest()
    if n <= 64:
        return seed[:n]
    return b"".join(hashlib.blake2b(k.to_bytes(8), key=seed).digest() for k in range(-(-n // 64)))[:n]


def _shift(of: list[int], sizes: list[int], tweak: str, p: PiiParams) -> list[int]:
    """One pseudo-random shift below each size, from 64 bits each."""
    words = np.frombuffer(_drawn(f"{tweak}|{bytes(of).hex()}", 8 * len(sizes), p), ">u8")
    return (words % np.array(sizes, np.uint64)).tolist()


def feistel_places(places: list[int], sizes: list[int], tweak: str, p: PiiParams) -> list[int]:
    """A keyed bijection on vectors with ``sizes`` values per place (at most 256): two halves shift each other's places in turn."""
    cut = len(places) // 2
    half, size = [places[:cut], places[cut:]], [sizes[:cut], sizes[cut:]]
    for i in range(p.rounds):
        by = _shift(half[1 - i % 2], size[i % 2], f"{tweak}|{i}", p)
        half[i % 2] = [(x + f) % n for x, f, n in zip(half[i % 2], by, size[i % 2])]
    return half[0] + half[1]


def feistel(x: int, left: int, right: int, tweak: str, p: PiiParams) -> int:
    """A keyed bijection on ``range(left * right)``."""
    a, b = divmod(x, right)
    for i in range(p.rounds):
        of, size = (b, left) if i % 2 == 0 else (a, right)
        # as many bits as the half has, and 64 more, so that every place of it is moved and the remainder is even
        f = int.from_bytes(_drawn(f"{tweak}|{i}|{of:x}", size.bit_length() // 8 + 9, p))
        if i % 2 == 0:
            a = (a + f) % size
        else:
            b = (b + f) % size
    return a * right + b


def permute(x: int, size: int, tweak: str, p: PiiParams, valid=lambda x: True) -> int:
    """A keyed bijection on the valid numbers below ``size``; ``x`` must be one of them."""
    left = 1
    while left * left < size:
        left *= 2
    right = -(-size // left)
    while True:
        x = feistel(x, left, right, tweak, p)
        if x < size and valid(x):
            return x


def _alphabets(s: str, hexes: bool = False) -> list[str]:
    if hexes and _HEX.fullmatch(s):
        return ["0123456789" + ("ABCDEF" if s.upper() == s else "abcdef")] * len(s)
    return ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            if c.isupper() else c for c in s]


def permute_string(s: str, tweak: str, p: PiiParams, alphabets: list[str] | None = None) -> str:
    """``s`` permuted among the strings of its shape (same alphabet at each place)."""
    abc = alphabets or _alphabets(s)
    if len(s) > p.long:
        shape = hashlib.blake2b("".join(a[0] + str(len(a)) for a in abc).encode()).hexdigest()
        places = feistel_places([a.index(c) for c, a in zip(s, abc)], [len(a) for a in abc], f"{tweak}|{shape}", p)
        return "".join(a[i] for a, i in zip(abc, places))
    x, size = 0, 1
    for c, a in zip(s, abc):
        x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join(a[0] + str(len(a)) for a in abc)
    x, out = permute(x, size, f"{tweak}|{shape}", p), []
    for a in reversed(abc):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it pass the Luhn test."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(s, p):
    d = re.sub(r"[ -]", "", s)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[0] + permute_string(d[1:-1], f"card{d[0]}", p)
    return _refill(s, body + str(luhn(body)))


def _ip(s, p):
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return None
    x = permute(int.from_bytes(bytes(o)), 1 << 32, "ip", p)
    return ".".join(map(str, x.to_bytes(4)))


def _day(y: str, m: str, d: str) -> int | None:
    try:
        at = datetime.date(int(y), int(m), int(d)).toordinal() - _DAY0
    except ValueError:
        return None
    return at if 0 <= at < _DAYS else None


def _date(s, p):
    sep = "-" if "-" in s else "." if "." in s else "/"
    part = s.split(sep)
    # places of year, month and day; month/day is tried before day/month
    for order in {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(0, 1, 2)] if len(part[0]) == 4 else [(2, 0, 1), (2, 1, 0)]}[sep]:
        at = _day(*(part[i] for i in order))
        if at is not None:
            break
    else:
        return None

    def late(x):
        return datetime.date.fromordinal(_DAY0 + x).day > 12
    # a day above 12 shows which number is the day: it stays above, so that the pseudonym is read in the same order
    own = late(at)
    t = datetime.date.fromordinal(_DAY0 + permute(at, _DAYS, "date", p, lambda x: late(x) == own))
    for i, x in zip(order, (t.year, t.month, t.day)):
        part[i] = str(x).zfill(len(part[i]))
    return sep.join(part)


def _ssn(s, p):
    def valid(x):
        return x // 10**6 not in (0, 666) and x < 9 * 10**8 and x // 10**4 % 100 and x % 10**4
    x = int(s.replace("-", ""))
    return _refill(s, f"{permute(x, 10**9, 'ssn', p, valid):09}") if valid(x) else None


def _phone(s, p):
    d = re.sub(r"[^0-9]", "", s)
    code = re.match(r"\+([0-9]{1,3})(?=[^0-9])", s)
    n = len(code[1]) if code else len(d) - 10 if len(d) in (10, 11) else 1
    head, rest = d[:n], d[n:]
    if len(rest) < 7:
        return None
    if len(rest) == 10 and head in ("", "1"):
        # in the number plan neither area nor exchange starts with 0 or 1; numbers outside it stay outside, by area and by exchange
        def planned(x):
            return (area := f"{x:010}"[0] > "1"), area and f"{x:010}"[3] > "1"
        if re.fullmatch(r"(1 ?)?[0-9]{3} [0-9]{3} [0-9]{4}", s) and not planned(int(rest))[0]:
            return None         # bare groups with blanks are a number only where the area can be one
        own = planned(int(rest))
        return _refill(s, head + f"{permute(int(rest), 10**10, 'phone1', p, lambda x: planned(x) == own):010}")
    return _refill(s, head + permute_string(rest, f"phone{head}", p))


def _iban(s, p):
    check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    tail = ""
    while not 15 <= len(t := s.replace(" ", "")) <= 34 or check(t) != 1:        # capitals behind the number may look like a part of it
        s, gap, last = s.rpartition(" ")
        if not gap:
            return None
        tail = gap + last + tail
    body = permute_string(t[4:], f"iban{t[:2]}", p)
    return _refill(s, f"{t[:2]}{98 - check(t[:2] + '00' + body):02}{body}") + tail


def _email(s, p):
    name, _, host = s.partition("@")
    return f"{permute_string(name, 'email@' + host.lower(), p)}@{host}"


def _secret(s, p):
    m = re.match(r"(AKIA|ghp_|sk-|\w+\s?[=:]\s?[\"']?)(.*)", s, re.S)
    return m[1] + permute_string(m[2], "secret", p, _alphabets(m[2], hexes=True))


_MAKE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(text: str, p: PiiParams) -> tuple[str, dict]:
    """The text with its private values replaced, and how many of each kind there were."""
    found: dict = {}

    def put(m):
        kind = m.lastgroup
        new = _MAKE[kind](m[0], p) if kind in p.kinds else None
        if new is None:
            return m[0]
        found[kind] = found.get(kind, 0) + 1
        return new

    return _PATTERN.sub(put, text), found


def replace(docs: DataFrame, p: PiiParams, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised; all other columns, whatever their names, as they are."""
    def run(batches):
        for b, out, _ in _replaced(batches, text, p):
            yield b.set_column(b.schema.get_field_index(text), pa.field(text, b.schema.field(text).type), pa.array(out, b.schema.field(text).type))
    return docs.mapInArrow(run, docs.schema)


def replace_counted(docs: DataFrame, p: PiiParams) -> DataFrame:
    """(doc_id, text, n_private, n_<kind>...) of every row."""
    def run(batches):
        for b, out, found in _replaced(batches, "text", p):
            counts = [[f.get(k, 0) for f in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array([sum(f.values()) for f in found], pa.int64()),
                                              *[pa.array(c, pa.int64()) for c in counts]], ["doc_id", "text", "n_private", *[f"n_{k}" for k in KINDS]])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_private long, " + ", ".join(f"n_{k} long" for k in KINDS))


def _replaced(batches, text: str, p: PiiParams):
    """Slices with their new texts. A text without digit, ``@`` or ``=`` holds no value but a bare key."""
    mark = np.zeros(256, np.int64)
    mark[list(b"0123456789@=:")] = 1
    for b in slices(batches, text):
        data, off = raw(b.column(text))
        marks = np.concatenate(([0], np.cumsum(mark[data])))[off]
        out, found = b.column(text).to_pylist(), [{}] * b.num_rows
        for i, t in enumerate(out):
            if t and (marks[i + 1] > marks[i] or "AKIA" in t or "ghp_" in t or "sk-" in t):
                out[i], found[i] = pseudonymise(t, p)
        yield b, out, found
