"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern and validated: card and account numbers by length and, where it
holds, the Luhn digit, IBANs by their country's length and their remainder, addresses by their bytes, dates by the calendar.
Each is then permuted by a keyed Feistel network within the set of values of its own format: digits
stay digits, a valid check digit stays valid, a date becomes another date in the same style.
Secrets, keys and addresses are replaced whole, however long.
The permutation depends on the key and the kind only, so equal values stay equal in all documents
and with the caller's key they can be turned back.  Numbers of fewer than twelve digits without a mark of
their kind (a leading +, brackets, the dashes of a social security number) are left alone, and so are local
phone numbers and dates before 1900.

Defined results: a null text stays null, an empty one empty; a very long text is read in one piece, in time
linear in its length; nothing depends on doc_id, so null and repeated ids pass; where patterns overlap the
earlier match, then the kind listed first, wins; repeated rows give equal results; an empty
table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
LONG = 256  # characters from which on values are permuted digit by digit and not remembered


class Feistel:
    """A keyed permutation of range(size), by a Feistel network over a * b >= size and cycle walking."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.blake2b(key).digest()[:32], kind.encode()[:16]

    def _f(self, r: int, value: int, size: int) -> int:
        raw = f"{r}:{size}:{value}".encode()
        n = 16 + size.bit_length() // 8
        out = b""
        while len(out) < n:
            out += hashlib.blake2b(raw + len(out).to_bytes(4, "big"), key=self.key, person=self.kind).digest()
        return int.from_bytes(out[:n], "big") % size

    def _once(self, x: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(x, b)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                left = (left + sign * self._f(r, right, a)) % a
            else:
                right = (right + sign * self._f(r, left, b)) % b
        return left * b + right

    def permute(self, x: int, size: int, back: bool = False) -> int:
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        x = self._once(x, a, b, back)
        while x >= size:
            x = self._once(x, a, b, back)
        return x

    def permute_digits(self, digits: list[int], sizes: list[int], back: bool = False) -> list[int]:
        """A permutation of mixed-radix numbers, digit by digit, in time linear in their length."""
        sizes, x, h = np.array(sizes, np.int64), np.array(digits, np.int64), len(digits) // 2
        halves, radix = [x[:h], x[h:]], sizes.astype(np.uint8).tobytes()
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            to = 1 - r % 2
            n = sizes[h:] if to else sizes[:h]
            seed = hashlib.blake2b(b"%d:" % r + radix + halves[1 - to].astype(np.uint8).tobytes(), key=self.key, person=self.kind).digest()
            pad = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(n)), "<u8") % n.astype(np.uint64)
            halves[to] = (halves[to] + (-1 if back else 1) * pad.astype(np.int64)) % n
        return np.concatenate(halves).tolist()


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_CLASS = {c: s for s in _CLASSES for c in s}
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_HEX_CLASS = {c: s for s in ("0123456789", "abcdef", "ABCDEF") for c in s}


def _shuffle(text: str, f: Feistel, back: bool, alphabet: str | None = None, classes: dict[str, str] = _CLASS) -> str:
    """Permutes the characters that have a class, each within its class; the others stay."""
    sets = [alphabet or classes.get(c) for c in text]
    if len(text) >= LONG:
        at = [i for i, (c, s) in enumerate(zip(text, sets)) if s and c in s]
        new = f.permute_digits([sets[i].index(text[i]) for i in at], [len(sets[i]) for i in at], back)
        out = list(text)
        for i, k in zip(at, new):
            out[i] = sets[i][k]
        return "".join(out)
    x = 0
    size = 1
    for c, s in zip(text, sets):
        if s and c in s:
            x, size = x * len(s) + s.index(c), size * len(s)
    if size == 1:
        return text
    x, out = f.permute(x, size, back), []
    for c, s in zip(reversed(text), reversed(sets)):
        if s and c in s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that completes these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """Puts the digits in the places of the shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def _number(text: str, f: Feistel, back: bool) -> str:
    d = _digits(text)
    if len(d) >= 12 and luhn(d[:-1]) == int(d[-1]):
        body = _shuffle(d[:-1], Feistel(f.key, "luhn"), back)
        return _fill(text, body + str(luhn(body)))
    # numbers without a valid check digit stay without one, so the two kinds cannot meet
    if len(d) >= 12:
        wrong = (int(d[-1]) - luhn(d[:-1]) - 1) % 10
        x = Feistel(f.key, "number").permute(int(d[:-1]) * 9 + wrong, 10 ** (len(d) - 1) * 9, back)
        body, wrong = divmod(x, 9)
        body = str(body).zfill(len(d) - 1)
        return _fill(text, body + str((luhn(body) + 1 + wrong) % 10))
    return _fill(text, _shuffle(d, f, back))


def _phone(text: str, f: Feistel, back: bool) -> str:
    lead = re.match(r"\+\d{1,3}(?=\D)|", text)[0]
    return lead + _fill(text[len(lead) :], _shuffle(_digits(text[len(lead) :]), f, back))


def _ip(text: str, f: Feistel, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _email(text: str, f: Feistel, back: bool) -> str:
    local, _, host = text.rpartition("@")
    host, dot, top = host.rpartition(".")
    return f"{_shuffle(local, f, back)}@{_shuffle(host, Feistel(f.key, 'host'), back)}{dot}{top}"


def _secret(text: str, f: Feistel, back: bool) -> str:
    for s in _HEX:
        if len(text) >= 16 and all(c in s for c in text):
            return _shuffle(text, f, back, s)
    return _shuffle(text, f, back)


_PREFIX = r"(?:AKIA|gh[pousr]_|sk-|xox[abp]-)"


def _key(text: str, f: Feistel, back: bool) -> str:
    n = len(m[0]) if (m := re.match(_PREFIX, text)) else 0  # a public prefix stays, so that the way back finds the key
    return text[:n] + _secret(text[n:], f, back)


#: The length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _valid_iban(raw: str) -> bool:
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _iban_end(text: str) -> int:
    """Where the account number at the start of the text ends (0: there is none); words in capitals may follow it.

    A known country fixes the length; else the longest valid number that ends at a space or the end counts.
    """
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    stops = [n for n in range(15, min(len(ends), 34) + 1) if n == len(ends) or text[ends[n - 1]] == " "]
    n = IBAN_LENGTHS.get(text[:2])
    for k in [n] if n else reversed(stops):
        if k in stops and _valid_iban(text[: ends[k - 1]].replace(" ", "")):
            return ends[k - 1]
    return 0


def _iban(text: str, f: Feistel, back: bool) -> str:
    raw = text.replace(" ", "")
    body = _shuffle(raw[4:], f, back)
    check = 98 - int("".join(str(int(c, 36)) for c in body + raw[:2] + "00")) % 97
    new = iter(raw[:2] + str(check).zfill(2) + body)
    return "".join(c if c == " " else next(new) for c in text)


def _ipv6(text: str, f: Feistel, back: bool) -> str | None:
    """Digits and letters of the groups, each within its class; shorter forms than two groups are no one's address."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return _shuffle(text, f, back, classes=_HEX_CLASS) if len([g for g in text.split(":") if g]) > 1 and re.search("[0-9]", text) else None


def _mac(text: str, f: Feistel, back: bool) -> str:
    return _shuffle(text, f, back, classes=_HEX_CLASS)


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(text: str, f: Feistel, back: bool) -> str | None:
    a, s1, b, s2, c = re.fullmatch(r"(\d+)(\D)(\d+)(\D)(\d+)", text).groups()
    order = "ymd" if len(a) == 4 else "mdy" if s1 == "/" and int(a) <= 12 else "dmy"
    v = dict(zip(order, map(int, (a, b, c))))
    try:
        day = (datetime.date(v["y"], v["m"], v["d"]) - _FIRST).days
    except ValueError:
        return None
    if s1 != s2 or not 0 <= day < _DAYS:
        return None
    walk = day
    while True:  # days that could be months stay among each other, so every style gives the same date and is read back
        walk = f.permute(walk, _DAYS, back)
        new = _FIRST + datetime.timedelta(walk)
        if (new.day > 12) == (v["d"] > 12):
            break
    w = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
    return s1.join(w[k] for k in order)


#: kind, pattern of the value, how to permute it; values in group "v" where the pattern has one.
KINDS = (
    ("email", r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)+[A-Za-z]{2,}", _email),
    ("secret", r"(?i:\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]key)?|token|passwd|password|bearer)\b[\"']?\s{0,3}(?:[=:]|is\s(?=\s{0,2}[\"']?[A-Za-z_/+.~-]*[0-9]))\s{0,3}[\"']?)([A-Za-z0-9_/+.~-]{8,}+)", _secret),
    ("key", rf"(?<![A-Za-z0-9]){_PREFIX}[A-Za-z0-9_-]{{12,}}+|(?<![A-Za-z0-9])(?=[0-9a-fA-F]*[0-9])(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)(?![A-Za-z0-9])", _key),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}+", _iban),
    ("mac", r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])", _mac),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{4,39}+(?![\w:])", _ipv6),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date", r"(?<![\d./-])(?:(?:19|20)\d\d([-/.])\d\d\1\d\d|\d\d?([-/.])\d\d?\2(?:19|20)\d\d)(?![\d]|[./-]\d)", _date),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", _phone),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _number),
    ("number", r"(?<![\w.-])\d{4}[ -]\d{6}[ -]\d{5}(?![\w-])|(?<![\w.-])\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?(?![\w-])|(?<!\w)\d{12,19}(?!\w)", _number),
)


def _master() -> tuple[re.Pattern, list[tuple[str, int, object]]]:
    """One pattern for all kinds, and each kind's group."""
    parts, kinds, n = [], [], 0
    for kind, pattern, f in KINDS:
        shifted = re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + n + 1}", pattern)  # noqa: B023
        parts.append(f"({shifted})")
        inner = re.compile(pattern).groups
        kinds.append((kind, n + 1, f, n + 2 if kind == "secret" else n + 1))
        n += 1 + inner
    return re.compile("|".join(parts)), kinds


class Pseudonyms:
    """Replaces values in texts; ``back`` turns its own results back."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.back = back
        self.find, self.kinds = _master()
        self.worth = re.compile(rf"[0-9@]|[A-Fa-f]{{2}}[:-][A-Fa-f]{{2}}[:-]|(?i:token|secret|passw|key|bearer)|{_PREFIX}").search
        self.feistel = {k: Feistel(key, k) for k, *_ in KINDS}
        self.memo: dict = {}

    def value(self, kind: str, f, value: str) -> str | None:
        if len(value) >= LONG:
            return f(value, self.feistel[kind], self.back)
        if (kind, value) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[kind, value] = f(value, self.feistel[kind], self.back)
        return self.memo[kind, value]

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The new text and (kind, start, end) of what was replaced, in the old text."""
        if not text or not self.worth(text):
            return text, []
        out, spans, last, at = [], [], 0, 0
        while m := self.find.search(text, at):
            kind, _, f, g = next(k for k in self.kinds if m[k[1]] is not None)
            end = m.end(g)
            if kind == "iban":
                end = m.start() + _iban_end(m[g]) if not text[end : end + 1].isalnum() or " " in m[g] else m.start()
            new = self.value(kind, f, text[m.start(g) : end]) if end > m.start() else None
            at = end if kind == "iban" else m.end()
            if new is None:  # not valid as this kind: look again from its next character
                at = m.start() + 1
                continue
            out += [text[last : m.start(g)], new]
            last = end
            spans.append((kind, m.start(g), end))
        return "".join([*out, text[last:]]), spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, spans: str | None = "pii_spans") -> DataFrame:
    """docs with ``text`` rewritten, all other columns as they are.

    key: the caller's secret; who has it can turn the values back, so it belongs in a secret store.
    spans: the name of an added column array<struct<kind, start, end>> of places in the old text, instead of one
    that is there under that name; None adds none.
    """
    if spans:
        docs = docs.drop(*[F.col(f"`{c}`") for c in docs.columns if c.lower() == spans.lower()])
    at = docs.columns.index("text")
    docs = docs.withColumn("text", docs["text"].cast("string")) if dict(docs.dtypes)["text"] != "string" else docs
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, SPANS)] if spans else [])])

    def run(batches):
        p = Pseudonyms(key, back)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            done = [p.apply(t) for t in b.column(at).to_pylist()]
            cols = b.columns
            cols[at] = pa.array([t for t, _ in done], pa.string())
            if spans:
                cols.append(pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for _, s in done], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
