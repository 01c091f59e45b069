"""Personal data replaced by format-preserving pseudonyms: keyed permutations of validated values within their format.

A permutation of N values leaves a given one as it is with a chance of 1 in N, so a value of a small format (four one-digit
octets have 10,000) may by such chance stay in the text.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, col, through

_ROUNDS = 8


def feistel(x: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over the two digits of x in a base near the root of size.

    The network permutes 0 .. a * b - 1 with a * b >= size; values that land at size or beyond go through it again.
    """
    if size < 2:
        return x
    a = _root(size)
    b = -(-size // a)
    while True:
        x = _backward(x, a, b, key) if back else _forward(x, a, b, key)
        if x < size:
            return x


def _root(n: int) -> int:
    r = 1 << (n.bit_length() + 1) // 2
    while r * r > n:
        r = (r + n // r) // 2
    return max(r, 1)


def _noise(i: int, half: int, key: bytes) -> int:
    data = bytes([i]) + half.to_bytes(half.bit_length() // 8 + 1, "big")
    digest = hashlib.blake2b(data, key=key, digest_size=64)
    return int.from_bytes(digest.digest(), "big")


def _forward(x: int, a: int, b: int, key: bytes) -> int:
    left, right = divmod(x, b)
    for i in range(0, _ROUNDS, 2):
        left = (left + _noise(i, right, key)) % a
        right = (right + _noise(i + 1, left, key)) % b
    return left * b + right


def _backward(x: int, a: int, b: int, key: bytes) -> int:
    left, right = divmod(x, b)
    for i in reversed(range(0, _ROUNDS, 2)):
        right = (right - _noise(i + 1, left, key)) % b
        left = (left - _noise(i, right, key)) % a
    return left * b + right


def luhn(digits: str) -> int:
    """The check digit that goes after these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def put(shape: str, digits: str) -> str:
    """The digits in the places where shape has digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def number(digits: str, key: bytes, back: bool) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, back)).zfill(len(digits))


# One function a kind: from the matched text to its pseudonym, or None if the text isn't valid.


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = only(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = number(digits[:-1], key + bytes([len(digits)]), back)
    return put(text, body + str(luhn(body)))


def phone(text: str, key: bytes, back: bool) -> str | None:
    """North American numbers: area and exchange begin with 2 to 9, and are permuted within that."""
    digits = only(text)
    country, digits = digits[:-10], digits[-10:]
    if country not in ("", "1") or len(digits) != 10 or digits[3] < "2":
        return None
    # Area codes below 200 aren't given out, but are left in no text either: they are permuted among themselves.
    low = digits[0] < "2"
    area, exchange = int(digits[:3]) - (0 if low else 200), int(digits[3:6]) - 200
    areas = 200 if low else 800
    x = feistel((area * 800 + exchange) * 10_000 + int(digits[6:]), areas * 8_000_000, key + b"l" * low, back)
    head, line = divmod(x, 10_000)
    area, exchange = divmod(head, 800)
    return put(text, f"{country}{area + (0 if low else 200):03d}{exchange + 200:03d}{line:04d}")


def phone_abroad(text: str, key: bytes, back: bool) -> str | None:
    """Numbers with a plus and a country code other than 1: all but the first three digits are permuted."""
    digits = only(text)
    if not 9 <= len(digits) <= 15 or digits[0] in "01":
        return None
    return put(text, digits[:3] + number(digits[3:], key + digits[:3].encode(), back))


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    """An address becomes one with octets of the same number of digits, so that texts keep their length."""
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    low, span = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    x, size = 0, 1
    for p in parts:
        x, size = x * span[len(p)] + int(p) - low[len(p)], size * span[len(p)]
    x, out = feistel(x, size, key + bytes(map(len, parts)), back), []
    for p in reversed(parts):
        x, octet = divmod(x, span[len(p)])
        out.append(str(octet + low[len(p)]))
    return ".".join(reversed(out))


def ssn(text: str, key: bytes, back: bool) -> str | None:
    a, b, c = text[:3], text[4:6], text[7:]
    if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
        return None
    areas = [i for i in range(1, 900) if i != 666]
    x = feistel((areas.index(int(a)) * 99 + int(b) - 1) * 9_999 + int(c) - 1, len(areas) * 99 * 9_999, key, back)
    head, tail = divmod(x, 9_999)
    area, group = divmod(head, 99)
    return f"{areas[area]:03d}{text[3]}{group + 1:02d}{text[6]}{tail + 1:04d}"


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = scramble(plain[4:], key + plain[:2].encode(), back)
    check = 98 - _mod97(plain[:2] + "00" + body)
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _mod97(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


#: Days that two-digit and four-digit dates are permuted within: those of the years 1900 to 2099.
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def date(text: str, key: bytes, back: bool) -> str | None:
    """yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd-mm-yyyy and mm/dd/yyyy (or dd/mm/yyyy where only that is a date) with real days; one digit will do between slashes and dashes.

    A day has one pseudonym in all of these. It is a day of the same kind: month and day have as many digits, and the
    day is over 12 or not, so each format can write it in the same length and is read the same again.
    """
    a, b, c = re.split(r"\D", text)
    first = len(a) == 4
    mark = text[4] if first else text[len(a)]
    order = "ymd" if first else "dmy" if mark in ".-" or int(a) > 12 else "mdy"
    part = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(*(int(part[k]) for k in "ymd"))
    except ValueError:
        return None
    if not 0 <= day.toordinal() - _FIRST < _DAYS:
        return None
    kind, new = _day_kind(day), day
    while new is day or _day_kind(new) != kind:
        new = datetime.date.fromordinal(_FIRST + feistel(new.toordinal() - _FIRST, _DAYS, key + kind, back))
    said = {"y": new.year, "m": new.month, "d": new.day}
    return mark.join(f"{said[k]:0{len(part[k])}d}" for k in order)


def _day_kind(day: datetime.date) -> bytes:
    return bytes([day.month > 9, (day.day > 9) + (day.day > 12)])


_KINDS = (("0123456789", "0"), ("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"))


def scramble(text: str, key: bytes, back: bool) -> str:
    """All ASCII letters and digits as one number of mixed bases, permuted; the rest stays, and so do case and kind."""
    sets = [next((s for s, _ in _KINDS if c in s), "") for c in text]
    shape = "".join(s[:1] or c for c, s in zip(text, sets, strict=True))
    x, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    x, out = feistel(x, size, key + hashlib.blake2b(shape.encode(), digest_size=8).digest(), back), []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def email(text: str, key: bytes, back: bool) -> str | None:
    """The name and the domain but its last label; the same address in other capitals gets the same letters."""
    head, dot, last = text.rpartition(".")
    new = scramble(head.lower(), key, back)
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, head, strict=True)) + dot + last


_HEX = "0123456789abcdef"


def hexadecimal(text: str, key: bytes, back: bool) -> str:
    digits = text.lower()
    out = f"{feistel(int(digits, 16), 16 ** len(digits), key + bytes([len(digits) % 256]), back):0{len(digits)}x}"
    return out.upper() if text.isupper() else out


_B36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def access_key(text: str, key: bytes, back: bool) -> str:
    x = feistel(int(text[4:], 36), 36 ** (len(text) - 4), key, back)
    out = ""
    for _ in text[4:]:
        x, k = divmod(x, 36)
        out = _B36[k] + out
    return text[:4] + out


def password(text: str, key: bytes, back: bool) -> str:
    at = re.match(r"[A-Za-z0-9_\-]+\s*[:=]\s*[\"']?", text).end()
    value = text[at:]
    return text[:at] + (hexadecimal(value, key, back) if re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", value) else scramble(value, key, back))


#: Each kind with its pattern and function, in the order in which they are tried at a place. What the formats are.
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    "secret": (r"(?i:(?:[a-z0-9]{1,16}[_\-]){0,3}(?:password|passwd|pwd|secret[_\-]?key|secret|api[_\-]?key|token))\s{0,3}[:=]\s{0,3}[\"']?(?=[A-Za-z_\-/+]{0,127}[0-9])[A-Za-z0-9_\-/+]{8,128}", password),
    "access_key": (r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])", access_key),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    "ipv4": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])", ipv4),
    "date": (r"(?:[0-9]{4}(?P<mark>[\-/])[0-9]{1,2}(?P=mark)[0-9]{1,2}|[0-9]{1,2}(?P<mark2>[/\-])[0-9]{1,2}(?P=mark2)[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])", date),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", ssn),
    "card": (r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])|[0-9](?:[ \-]?[0-9]){12,18}(?=[ \-][0-9])", card),
    "phone": (r"(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|\+1[0-9]{10}(?![0-9])", phone),
    "phone_abroad": (r"\+[2-9](?:[ .\-()]{0,2}[0-9]){8,14}(?![0-9])", phone_abroad),
}
_COMPILED = {k: re.compile(p) for k, (p, _) in KINDS.items()}
#: Kinds whose longest match may take in what follows the value: where it isn't valid, shorter ones are tried, that end before a space or dash.
_SHORTER = {"card": re.compile(r"[ \-]"), "iban": re.compile(" ")}
_ANY = re.compile("|".join(p for p, _ in KINDS.values()))
#: Every value holds one of these within _BACK places of its start, so text far from them is passed over.
_MARK, _BACK = re.compile(r"[0-9@A](?:(?<=[0-9@])|(?<=A)[KS]IA)"), 208
#: Where a value may start: not inside a word or number.
_START = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9(+]")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    old: str
    new: str


@lru_cache(maxsize=64)
def derived(secret: bytes, kind: str) -> bytes:
    return hmac.new(secret, kind.encode(), "sha256").digest()


def find(text: str | None, secret: bytes, back: bool = False) -> Iterator[Found]:
    """The validated values of a text in order, none inside another, with their pseudonyms.

    Where a match isn't valid, the other kinds are tried at the same place, then the next place.
    """
    seen, mark = 0, _MARK.search(text) if text else None
    while mark:
        hit = None
        for m in _START.finditer(text, max(seen, mark.start() - _BACK), mark.start() + 1):
            if _ANY.match(text, m.start()) and (hit := _valid(text, m.start(), secret, back)):
                yield hit
                break
        seen = hit.end if hit else mark.start() + 1
        mark = _MARK.search(text, seen)


def _valid(text: str, start: int, secret: bytes, back: bool) -> Found | None:
    for kind, (_, pseudonym) in KINDS.items():
        if (m := _COMPILED[kind].match(text, start)) and not (kind == "ipv4" and re.search(r"[0-9]\.$", text[max(0, start - 2) : start])):
            ends = [len(m[0]), *(x.start() for x in reversed(list(_SHORTER[kind].finditer(m[0]))))] if kind in _SHORTER else [len(m[0])]
            for end in ends:
                new = pseudonym(m[0][:end], derived(secret, kind), back)
                if new is not None:
                    return Found(start, start + end, kind, m[0][:end], new)
    return None


def replaced(text: str | None, secret: bytes, back: bool = False) -> str | None:
    if text is None:
        return None
    return _joined(text, list(find(text, secret, back)))


#: The session's setting that has the secret, and what is used where it is unset: no secret, as anyone can read it here.
SETTING, EXAMPLE = "spark.graphloom.pii.secret", b"example key, known to all"


def secret_of(spark: SparkSession) -> bytes:
    """The secret from the session's settings; without one a warning and the example, whose pseudonyms anyone can undo."""
    found = spark.conf.get(SETTING, None)
    if found is None:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a key that is known to all", stacklevel=2)
    return EXAMPLE if found is None else found.encode()


def pseudonymise(docs: DataFrame, secret: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with each validated value in the text replaced by its pseudonym; back undoes it. All columns and rows stay.

    A value's pseudonym depends on the key, its kind and its format alone (a day's not on the format of the date), so
    equal values stay linked across documents, and different ones stay different. Cards keep their length and a right check digit, dates stay dates,
    addresses and phone numbers stay ones, so texts keep their lengths. back finds the pseudonyms as values are found, so
    it misses one after which digits stand that by chance make it part of a longer valid number. Null and empty texts stay. Extra columns,
    whatever their names, and repeated rows stay. An empty table stays empty. Rows aren't moved: no shuffle.
    """
    place = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        cols = list(b.columns)
        cols[place] = pa.array([replaced(t, secret, back) for t in cols[place].to_pylist()], pa.string())
        return cols

    return through(docs, run)


def report(docs: DataFrame, secret: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_found, kinds, spans): the new text, and what was replaced in it, in code points of either text."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(doc_id, text):
        hits = [list(find(t, secret)) for t in text]
        spans = [[{"start": f.start, "end": f.end, "kind": f.kind, "pseudonym": f.new} for f in h] for h in hits]
        return doc_id, [_joined(t, h) for t, h in zip(text, hits, strict=True)], [len(h) for h in hits], [sorted({f.kind for f in h}) for h in hits], spans

    return by_batch(named, ["doc_id", "text"], run, f"doc_id {kind}, text string, n_found long, kinds array<string>, spans array<struct<start: int, end: int, kind: string, pseudonym: string>>")


def _joined(text: str | None, hits: list[Found]) -> str | None:
    if not hits:
        return text
    out, at = [], 0
    for f in hits:
        out += [text[at : f.start], f.new]
        at = f.end
    return "".join(out) + text[at:]
