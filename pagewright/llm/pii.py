"""PII: format-preserving pseudonyms from a keyed Feistel network.

What is found and validated is permuted within its own format: a card number becomes another card number that
passes its check digit, a date another date, an address another address of the same shape. The permutation
depends on the key, the kind and the format only, so equal values get equal pseudonyms in all documents and stay
linked, and whoever has the key can go back (back=True).
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import read_table, with_fields

ROUNDS = 10
KINDS = ("email", "phone", "ip", "card", "account", "iban", "ssn", "date", "secret")
#: For tests and the registered query; a real run passes its own.
DEMO_KEY = b"pagewright demonstration key"

_DAY_ZERO, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049
_UPPER, _LOWER, _DIGITS, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


class Feistel:
    """Keyed permutations of mixed-radix numbers: alternating rounds over two halves, with modular addition."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, n: int, half: int, size: int) -> int:
        text = tweak + n.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8 + 1, "big")
        wide = hashlib.blake2b(text, key=self.key, digest_size=min(64, (size.bit_length() + 7) // 8 + 8)).digest()
        return int.from_bytes(wide, "big") % size

    def number(self, value: int, left: int, right: int, tweak: bytes, back: bool = False) -> int:
        """Permute 0 <= value < left * right."""
        a, b = divmod(value, right)
        for n in range(ROUNDS) if not back else reversed(range(ROUNDS)):
            sign = -1 if back else 1
            if n % 2:
                b = (b + sign * self._round(tweak, n, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, n, b, left)) % left
        return a * right + b

    def below(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """Permute 0 <= value < size, walking the cycle of a slightly larger square until it is back inside."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            value = self.number(value, side, side, tweak, back)
            if value < size:
                return value

    def letters(self, text: str, alphabets: list[str], tweak: bytes, back: bool = False) -> str:
        """Permute a string whose k-th character is from the k-th alphabet; the shape of the string is part of the tweak."""
        if not text:
            return text
        half = len(text) // 2
        sizes = [1, 1]
        for k, alphabet in enumerate(alphabets):
            sizes[k >= half] *= len(alphabet)
        value = 0
        for char, alphabet in zip(text, alphabets, strict=True):
            value = value * len(alphabet) + alphabet.index(char)
        shape = tweak + b"|" + ",".join(str(len(a)) for a in alphabets).encode()
        value = self.number(value, sizes[0], sizes[1], shape, back) if half else self.below(value, sizes[1], shape, back)
        out = []
        for alphabet in reversed(alphabets):
            value, k = divmod(value, len(alphabet))
            out.append(alphabet[k])
        return "".join(reversed(out))

    def within(self, text: str, tweak: bytes, alphabet_of: Callable[[str], str | None], back: bool = False) -> str:
        """Permute the characters that have an alphabet, leave the others where they are."""
        places = [(k, a) for k, c in enumerate(text) if (a := alphabet_of(c))]
        new = self.letters("".join(text[k] for k, _ in places), [a for _, a in places], tweak, back)
        chars = list(text)
        for (k, _), c in zip(places, new, strict=True):
            chars[k] = c
        return "".join(chars)


def by_class(c: str) -> str | None:
    return _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else None


def digits_only(c: str) -> str | None:
    return _DIGITS if c in _DIGITS else None


def luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_check(bban: str, country: str) -> str:
    spelled = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{98 - int(spelled) % 97:02d}"


def parse_date(text: str) -> tuple[datetime.date, str, tuple[int, int, int], tuple[int, int]] | None:
    """A date of 1900-2099, its separator, the places of year, month and day, and the widths kept of month and day.

    Year first, or day.month.year, or month/day/year and where that is no date day/month/year; the same with dashes.
    A width of 0 says that month and day are written as short as they are, 1 and 2 that each keeps its own width.
    """
    sign = next((c for c in "-./" if c in text), "")
    parts = text.split(sign) if sign else []
    if len(parts) != 3:
        return None
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0),) if sign == "." else ((2, 0, 1), (2, 1, 0))
    for order in orders:
        year, month, day = (int(parts[k]) for k in order)
        widths = tuple(len(parts[k]) for k in order[1:])
        try:
            date = datetime.date(year, month, day)
        except ValueError:
            continue
        if not 0 <= date.toordinal() - _DAY_ZERO < _DAYS:
            continue
        led = any(parts[k][0] == "0" for k in order[1:])
        return date, sign, order, (2, 2) if widths == (2, 2) else widths if led else (0, 0)
    return None


def _write_date(date: datetime.date, sign: str, order: tuple[int, int, int], widths: tuple[int, int]) -> str:
    parts = [""] * 3
    for k, value, width in zip(order, (date.year, date.month, date.day), (4, *widths), strict=True):
        parts[k] = str(value).zfill(width)
    return sign.join(parts)


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Another date in the same format. Dates that the format cannot tell apart from another's are walked past, so it can be undone."""
    parsed = parse_date(text)
    if parsed is None:
        return None
    date, *shape = parsed
    while True:
        date = datetime.date.fromordinal(_DAY_ZERO + f.below(date.toordinal() - _DAY_ZERO, _DAYS, b"date", back))
        new = _write_date(date, *shape)
        if parse_date(new) == (date, *shape):
            return new


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = f.number(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _long_number(f: Feistel, text: str, back: bool) -> tuple[str, str] | None:
    """A card keeps a valid check digit, other numbers of 13 to 19 digits keep an invalid one, so the two sets stay apart."""
    digits = "".join(c for c in text if c in _DIGITS)
    if not 13 <= len(digits) <= 19:
        return None
    check = luhn_sum(digits)
    body = f.letters(digits[:-1], [_DIGITS] * (len(digits) - 1), b"card" if check == 0 else b"account", back)
    last = str((10 - luhn_sum(body + "0") + check) % 10)
    new = iter(body + last)
    return "".join(next(new) if c in _DIGITS else c for c in text), "card" if check == 0 else "account"


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[4:], plain[:2]) != plain[2:4]:
        return None
    body = f.within(plain[4:], b"iban" + plain[:2].encode(), by_class, back)
    new = iter(plain[:2] + iban_check(body, plain[:2]) + body)
    return "".join(c if c == " " else next(new) for c in text)


def _secret(f: Feistel, text: str, back: bool) -> str:
    if re.fullmatch(r"[0-9a-f]+", text):
        return f.within(text, b"hex", lambda c: _HEX, back)
    if re.fullmatch(r"[0-9A-F]+", text):
        return f.within(text.lower(), b"hex", lambda c: _HEX, back).upper()
    head = next((p for p in ("AKIA", "ASIA", "ghp_", "sk_live_", "sk-") if text.startswith(p)), "")
    return head + f.within(text[len(head) :], b"secret", by_class, back)


_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OTHER = re.compile(
    r"(?P<assigned>(?<![0-9A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z_+/-]{6,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|sk-[A-Za-z0-9]{32,}|(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}))(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])(?:[0-9]{3}(?P<dash>[.-])[0-9]{3}(?P=dash)[0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}|\(0[0-9]{2,4}\)[ -]?[0-9]{3,4}[ -]?[0-9]{3,4})(?![0-9A-Za-z]|[.-][0-9]| [0-9]{3}))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<first>[-/])[0-9]{1,2}(?P=first)[0-9]{1,2}|[0-9]{1,2}(?P<last>[./-])[0-9]{1,2}(?P=last)[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
)
_KINDS = ("assigned", "secret", "iban", "phone", "ip", "ssn", "date", "card")
#: No other kind but email is without two digits side by side or a named secret; most texts stop here.
_ABLE = re.compile(r"[0-9][0-9]|[0-9][ .-][0-9]|AKIA|ASIA|ghp_|sk_live_|sk-|[=:]")


def find_and_replace(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of each in the text given."""
    spots: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            local, _, domain = m[0].partition("@")
            spots.append((m.start(), m.end(), "email", f.within(local, b"email", by_class, back) + "@" + domain))
    if _ABLE.search(text):
        for m in _OTHER.finditer(text):
            kind, found = next(k for k in _KINDS if m[k]), m[0]
            new: str | None
            begin = m.start()
            if kind == "assigned":
                kind, begin = "secret", begin + re.match(r"(?s).*[=:]\s*[\"']?", found).end()
                found = text[begin : m.end()]
                if not any(c in _DIGITS for c in found):
                    continue  # a word, not a secret
            if kind == "card":
                pair = _long_number(f, found, back)
                new, kind = pair if pair else (None, kind)
            elif kind == "phone":
                head = "" if m["dash"] else re.match(r"\+[0-9]{1,3}(?=[ .-])|\(?0|", found)[0]
                new = head + f.within(found[len(head) :], b"phone", digits_only, back)
            elif kind == "ssn":
                new = f.within(found, b"ssn", digits_only, back)
            else:
                new = {"secret": _secret, "iban": _iban, "ip": _ip, "date": _date}[kind](f, found, back)
            if new is not None:
                spots.append((begin, m.end(), kind, new))
    if not spots:
        return text, []
    spots.sort()
    out, at, said = [], 0, []
    for begin, end, kind, new in spots:
        if begin < at:
            continue  # inside an address that was replaced
        out += [text[at:begin], new]
        said.append((kind, begin, end))
        at = end
    return "".join([*out, text[at:]]), said


def pseudonymise(documents: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """documents with text replaced, plus pii: array of (kind, begin, end), places in the text before.

    One pass without a shuffle, whole texts. Null texts stay null with no finds, empty ones empty. Repeated rows
    get equal results. A column named pii is replaced, all others are kept. back undoes a pass with the same key.
    """
    df = documents.drop("pii")
    names = df.columns
    at = names.index("text")
    feistel = Feistel(key)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, finds = [], []
            for text in batch.column(at).to_pylist():
                new, found = (None, []) if text is None else find_and_replace(text, feistel, back)
                texts.append(new)
                finds.append([{"kind": k, "begin": a, "end": b} for k, a, b in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(finds, kind)], [*names, "pii"])

    return df.mapInArrow(run, with_fields(df, "pii array<struct<kind:string,begin:int,end:int>>"))


def _kind_filter(kind: str) -> Callable[[Column], Column]:
    return lambda find: find["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read_table(spark, sf_dir, "documents", "doc_id", "text"), DEMO_KEY)
    counts = [F.size(F.filter("pii", _kind_filter(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", "text", *counts)
