"""Format-preserving pseudonyms for personal data.

Validated values are replaced inside the whole text by a keyed permutation of
their own format: card numbers (Luhn), IBANs (mod 97), social security numbers,
phone numbers, IPv4 and IPv6 addresses, calendar dates (in figures, and with a month's
name in four languages) and e-mail addresses.  Widths and case are kept.  A value is
read as an integer of its format's domain and permuted by a mixed-radix Feistel
network whose round function is a keyed hash; results outside the domain are
walked on until they are inside, so the map is one to one.  Equal values get
equal pseudonyms in every document, and the key holder can invert the map.
Check digits are computed anew, so pseudonyms validate like their originals.

A value ends where its digits end: letters, commas, times and other values may
touch it.  Numbers that fail validation stay as they are, and so does all other text.  A
null text stays null.  Other columns pass through unchanged, whatever their
names; repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import os
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import slices

KEY_SETTING = "quire.pseudonym.key"
ROUNDS = 10
_EPOCH = dt.date(1900, 1, 1)
_DAYS = (dt.date(2100, 1, 1) - _EPOCH).days


class Feistel:
    """Keyed permutation of ``range(n)`` for any ``n``; ``tweak`` names the format."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key[:64], inverse

    def _round(self, tweak: str, n: int, i: int, half: int) -> int:
        data = f"{tweak}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        sign = -1 if self.inverse else 1
        order = range(ROUNDS - 1, -1, -1) if self.inverse else range(ROUNDS)
        while True:
            left, right = divmod(x, b)
            for i in order:
                if i % 2:
                    right = (right + sign * self._round(tweak, n, i, left)) % b
                else:
                    left = (left + sign * self._round(tweak, n, i, right)) % a
            x = left * b + right
            if x < n:
                return x

    def walk(self, x: int, n: int, tweak: str, valid) -> int:
        """Permutes within the values of ``range(n)`` that are ``valid``."""
        while True:
            x = self.permute(x, n, tweak)
            if valid(x):
                return x

    def digits(self, digits: str, tweak: str) -> str:
        return str(self.permute(int(digits), 10 ** len(digits), tweak)).zfill(len(digits)) if digits else ""

    def symbols(self, text: str, tweak: str) -> str:
        """Permutes the ASCII letters and digits of a text among those of their class."""
        sizes = [(string.digits, 10) if c in string.digits else (string.ascii_lowercase, 26) if c in string.ascii_lowercase
                 else (string.ascii_uppercase, 26) if c in string.ascii_uppercase else None for c in text]
        x, n = 0, 1
        for c, s in zip(text, sizes):
            if s:
                x, n = x * s[1] + s[0].index(c), n * s[1]
        shape = "".join(c if s is None else s[0][0] for c, s in zip(text, sizes))
        x = self.permute(x, n, tweak + shape)
        out = []
        for c, s in zip(reversed(text), reversed(sizes)):
            if s:
                x, k = divmod(x, s[1])
                c = s[0][k]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` pass the Luhn test."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """Puts digits in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in shape)


def _only(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _card(m: re.Match, f: Feistel):
    d = _only(m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + f.digits(d[1:-1], "card" + d[0])
    return _fill(m[0], body + luhn_digit(body))


def _ssn(m: re.Match, f: Feistel):
    def valid(x):
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0
    x = int(_only(m[0]))
    return _fill(m[0], str(f.walk(x, 10 ** 9, "ssn", valid)).zfill(9)) if valid(x) else None


def _nanp(m: re.Match, f: Feistel):
    """North American numbers: area code and exchange start with 2 to 9."""
    d = _only(m[0])
    prefix, d = d[:-10], d[-10:]

    def valid(x):
        return x // 10 ** 9 >= 2 and x // 10 ** 6 % 10 >= 2
    return _fill(m[0], prefix + str(f.walk(int(d), 10 ** 10, "nanp", valid)).zfill(10)) if valid(int(d)) else None


def _phone(m: re.Match, f: Feistel):
    d = _only(m[0])
    if not 8 <= len(d) <= 15:
        return None
    code = _only(m[1])
    return _fill(m[0], code + f.digits(d[len(code):], "phone" + code))


def _ip(m: re.Match, f: Feistel):
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _as_date(y: int, mth: int, d: int):
    try:
        date = dt.date(y, mth, d)
    except ValueError:
        return None
    return date if 0 <= (date - _EPOCH).days < _DAYS else None


def _date(m: re.Match, f: Feistel):
    numbers = re.findall(r"[0-9]+", m[0])
    sep = re.sub(r"[0-9]", "", m[0])
    if len(numbers) != 3 or sep[0] != sep[1]:
        return None
    if len(numbers[0]) == 4:
        kinds = "ymd"
    else:       # day first where that is a date, else month first
        kinds = "dmy" if _as_date(int(numbers[2]), int(numbers[1]), int(numbers[0])) else "mdy"
    at, width = dict(zip(kinds, map(int, numbers))), dict(zip(kinds, map(len, numbers)))
    date = _as_date(at["y"], at["m"], at["d"])
    if date is None:
        return None

    def valid(x):
        """A value that is written in the same widths and read in the same order: months
        first only where the day is above 12."""
        new = _EPOCH + dt.timedelta(x)
        return (width["m"] > 1 or new.month < 10) and (width["d"] > 1 or new.day < 10) and (kinds != "mdy" or new.day > 12)

    new = _EPOCH + dt.timedelta(f.walk((date - _EPOCH).days, _DAYS, f"date{kinds}{width['m']}{width['d']}", valid))
    value = {"y": f"{new.year:04d}", "m": f"{new.month:0{width['m']}d}", "d": f"{new.day:0{width['d']}d}"}
    return sep[0].join(value[k] for k in kinds)


#: month names, by language in the order in which a name is looked up
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_MONTH_OF = {}
for _lang, _names in MONTHS.items():
    for _number, _name in enumerate(_names, 1):
        _MONTH_OF.setdefault(_name.lower(), (_lang, _number))


def _cased(name: str, like: str) -> str:
    return name.upper() if like.isupper() else name.lower() if like.islower() else name.capitalize()


def _worded_date(m: re.Match, f: Feistel):
    """A date with a month's name keeps its form, its language and the width of the day."""
    name, day, year = m["month"], m["day"], m["year"]
    lang, month = _MONTH_OF[name.lower()]
    date = _as_date(int(year), month, int(day))
    if date is None:
        return None

    def valid(x):
        """Names that two languages share are read as those of the first."""
        new = _EPOCH + dt.timedelta(x)
        return _MONTH_OF[MONTHS[lang][new.month - 1].lower()][0] == lang and (len(day) > 1 or new.day < 10)

    new = _EPOCH + dt.timedelta(f.walk((date - _EPOCH).days, _DAYS, f"date{lang}{len(day)}", valid))
    made = {"month": _cased(MONTHS[lang][new.month - 1], name), "day": f"{new.day:0{len(day)}d}", "year": f"{new.year:04d}"}
    out, last = [], m.start()
    for group in sorted(made, key=m.start):
        out += [m.string[last:m.start(group)], made[group]]
        last = m.end(group)
    return "".join([*out, m.string[last:m.end()]])


def _national(m: re.Match, f: Feistel):
    """A number that begins with a trunk 0: the digits after it and the first of the
    area code are permuted."""
    d = _only(m[0])
    return _fill(m[0], d[:2] + f.digits(d[2:], "national" + d[1])) if 9 <= len(d) <= 13 else None


def _ipv6(m: re.Match, f: Feistel):
    """Groups keep their widths and the case of their letters; ``::`` stays where it is.
    A group of several digits has no leading zero, unless the original's has one."""
    try:
        ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    groups = m[0].split(":")
    shape = [(len(g), len(g) > 1 and g[0] == "0") for g in groups]
    x, n = 0, 1
    for g, (w, zero) in zip(groups, shape):
        if w:
            low, size = (0, 16 ** (w - 1)) if zero else (16 ** (w - 1) if w > 1 else 0, 16 ** w - (16 ** (w - 1) if w > 1 else 0))
            x, n = x * size + int(g, 16) - low, n * size
    x = f.permute(x, n, "ipv6" + str(shape))
    upper = any(c.isupper() for c in m[0])
    out = []
    for w, zero in reversed(shape):
        if not w:
            out.append("")
            continue
        low, size = (0, 16 ** (w - 1)) if zero else (16 ** (w - 1) if w > 1 else 0, 16 ** w - (16 ** (w - 1) if w > 1 else 0))
        x, v = divmod(x, size)
        out.append(f"{v + low:0{w}{'X' if upper else 'x'}}")
    return ":".join(reversed(out))


def _iban(m: re.Match, f: Feistel):
    compact = m[0].replace(" ", "").upper()
    if not 15 <= len(compact) <= 34 or len({c.isupper() for c in m[0] if c.isalpha()}) > 1:
        return None
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(compact[4:] + compact[:4]) % 97 != 1:
        return None
    body = f.symbols(compact[4:], "iban" + compact[:2])
    check = 98 - number(body + compact[:2] + "00") % 97
    it = iter(compact[:2] + f"{check:02d}" + body)
    new = "".join(c if c == " " else next(it) for c in m[0])
    return new.lower() if m[0][0].islower() else new


_END = r"(?![0-9])"
_NAMES = "|".join(sorted({n for names in MONTHS.values() for n in names}, key=lambda n: (-len(n), n)))
#: tried in this order where a value may begin
FORMATS = [
    ("date", re.compile(r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})" + _END), _date),
    ("date", re.compile(rf"(?P<day>[0-9]{{1,2}})(?:\.|st|nd|rd|th|er)? (?:de )?(?P<month>{_NAMES}),? (?:de )?(?P<year>[0-9]{{4}})" + _END, re.I), _worded_date),
    ("date", re.compile(rf"(?P<month>{_NAMES}) (?P<day>[0-9]{{1,2}})(?:st|nd|rd|th)?,? (?P<year>[0-9]{{4}})" + _END, re.I), _worded_date),
    ("ip", re.compile(r"(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"), _ipv6),
    ("ip", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END), _ip),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END), _ssn),
    ("card", re.compile(r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})" + _END), _card),
    ("phone", re.compile(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END), _nanp),
    ("phone", re.compile(r"\+1[0-9]{10}" + _END), _nanp),
    ("phone", re.compile(r"0[1-9][0-9]{1,4}[ /-][0-9]{5,9}" + _END), _national),
    ("phone", re.compile(r"\+([0-9]{1,3})[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _END), _phone),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"), _iban),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])"), _iban),
    ("iban", re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![A-Za-z0-9_])"), _iban),
]
_BEGIN = re.compile(rf"(?<![A-Za-z0-9_])(?:[+(]?[0-9]|[A-Z]{{2}}[0-9]{{2}}|[a-z]{{2}}[0-9]{{2}}|[A-Fa-f][0-9A-Fa-f]{{0,3}}:|(?i:{_NAMES}) [0-9])")


def _part_of_longer(text: str, kind: str, begin: int, end: int, last: int) -> bool:
    """Whether a match is a piece of a longer number, as in ``1.2.3.4.5``: more digits
    follow or go before across a separator that it uses itself, or across a dot if it
    has none.  A comma never joins, nor does what stands after a value that ended at
    ``last``; after a date a hyphen may lead on to a time or to another date."""
    if kind == "iban" or ":" in text[begin:end]:
        return False
    own = {c for c in text[begin:end] if c in ".-"} or {"."}
    if text[end:end + 1] in own and text[end + 1:end + 2] in _DIGITS and not (kind == "date" and text[end] == "-"):
        return True
    return begin > 1 and begin - 1 != last and text[begin - 1] in own and text[begin - 2] in _DIGITS


_DIGITS = frozenset(string.digits)
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+)([A-Za-z]{2,24})(?![\w-])")
#: symbols that are permuted together; a longer name is permuted piece by piece
PIECE = 64


def _name(text: str, f: Feistel, tweak: str) -> str:
    """Letters and digits of a name of any length; upper-case letters stay upper-case,
    and names that differ by case only stay alike."""
    low = text.lower()
    new = "".join(f.symbols(low[i:i + PIECE], f"{tweak}{i}") for i in range(0, len(low), PIECE))
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, text))


def _emails(text: str, f: Feistel):
    at = text.find("@")
    floor = 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and text[begin] in "._%+-":
            begin += 1
        m = _DOMAIN.match(text, at)
        if m and begin < at:
            domain = m[1] + m[2]
            yield begin, at + 1 + len(domain), "email", _name(text[begin:at], f, "local") + "@" + _name(m[1], f, "domain") + m[2]
            floor = at + 1 + len(domain)
        at = text.find("@", max(at + 1, floor))


def find_values(text: str, f: Feistel):
    """``(begin, end, kind, pseudonym)`` of the values of a text, in order."""
    found = list(_emails(text, f)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    taken = iter([*found, (len(text) + 1, 0, "", "")])
    ahead, pos, own, last = next(taken), 0, [], -1
    while m := _BEGIN.search(text, pos):
        at = m.start()
        while ahead[0] <= at and ahead[1] <= at and ahead[2]:
            ahead = next(taken)
        if ahead[0] <= at:
            pos = ahead[1]
            continue
        pos = at + 1
        for kind, pattern, make in FORMATS:
            value = pattern.match(text, at)
            if value and value.end() <= ahead[0] and not _part_of_longer(text, kind, at, value.end(), last) \
                    and (new := make(value, f)) is not None:
                own.append((at, value.end(), kind, new))
                pos = last = value.end()
                break
    return sorted(found + own)


def pseudonymise_text(text: str, f: Feistel) -> tuple[str, list[str]]:
    out, last, kinds = [], 0, []
    for begin, end, kind, new in find_values(text, f):
        out += [text[last:begin], new]
        last = end
        kinds.append(kind)
    return ("".join([*out, text[last:]]) if kinds else text), kinds


_RANDOM_KEY = os.urandom(32)


def session_key(spark: SparkSession) -> bytes:
    """The key named in the setting ``quire.pseudonym.key``; where it is unset, a random
    one that this application keeps to itself, so its pseudonyms are linked within the
    application only and nobody can invert them."""
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(named.encode()).digest() if named else _RANDOM_KEY


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False, report: str | None = None) -> DataFrame:
    """``docs`` with its texts replaced; ``report`` names an added column that
    lists the kinds of the replaced values in order of appearance."""
    if report and report in docs.columns:
        raise ValueError(f"column {report!r} exists")
    schema = T.StructType(docs.schema.fields + ([T.StructField(report, T.ArrayType(T.StringType()))] if report else []))
    at = [f.name for f in docs.schema.fields].index("text")

    def task(batches):
        f = Feistel(key, inverse)
        for batch in slices(batches):
            made = [(None, []) if t is None else pseudonymise_text(t, f) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([m[0] for m in made], pa.string())
            names = list(batch.schema.names)
            if report:
                columns.append(pa.array([m[1] for m in made], pa.list_(pa.string())))
                names.append(report)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(task, schema)
