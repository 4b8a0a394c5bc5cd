"""Format-preserving pseudonyms for personal data.

Validated values (payment cards by Luhn, IBANs by mod 97, national phone
numbers, IPv4 addresses, social security numbers, calendar dates, e-mail
addresses, access keys) are mapped to integers of their format's domain,
permuted there by a keyed Feistel network with cycle walking, and written back
in the same layout. The map is a bijection of each format, so equal values
stay equal across documents and differing ones stay different, and separators
don't matter: the digits alone decide.

Defined results: NULL text -> NULL text and ``n_pii`` 0; empty text -> empty
text; numbers that fail validation are left alone, but
telephone numbers outside the national plan and all dotted quads are mapped; a value whose domain has a
single element is left alone. Where two readings overlap, the one that starts
first wins, then the order of ``_KINDS``. Texts are processed whole. Extra
columns are kept; an input column called ``n_pii`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ROUNDS = 10


class Feistel:
    """Keyed permutation of range(n), tweaked by a format name."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        width = bits // 8 + 9
        d = hashlib.blake2b(tweak + bytes([i]) + x.to_bytes(bits // 8 + 1, "big"), key=self.key, digest_size=min(64, width)).digest()
        return int.from_bytes(d, "big") & ((1 << bits) - 1)

    def _pass(self, x: int, half: int, tweak: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for i in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
            if back:
                a, b = b ^ self._round(tweak, i, a, half), a
            else:
                a, b = b, a ^ self._round(tweak, i, b, half)
        return a << half | b

    def permute(self, x: int, n: int, tweak: str, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Image of x in the *valid* part of range(n); *back* inverts."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        t = f"{tweak}:{n}".encode()
        y = self._pass(x, half, t, back)
        while y >= n or not valid(y):
            y = self._pass(y, half, t, back)
        return y


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(layout: str, chars: str) -> str:
    """*layout* with its letters and digits replaced by *chars* in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _card(m: str, f: Feistel, back: bool) -> str | None:
    d = "".join(filter(str.isdigit, m))
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    same = lambda x: len(set(s := f"{x:0{len(d) - 1}d}")) > 1 or luhn_digit(s) != int(s[0])
    p = f"{f.permute(int(d[:-1]), 10 ** (len(d) - 1), 'card', back, same):0{len(d) - 1}d}"
    return _refill(m, p + str(luhn_digit(p)))


def _iban(m: str, f: Feistel, back: bool) -> str | None:
    s = m.replace(" ", "").upper()
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _classes(s[4:], f, "iban" + s[:2], back)
    return _refill(m, f"{s[:2]}{98 - number(body + s[:2] + '00') % 97:02d}{body}")


def _phone(m: str, f: Feistel, back: bool) -> str | None:
    d = "".join(filter(str.isdigit, m))
    lead, d = (d[:-10], d[-10:]) if len(d) in (10, 11) and (len(d) == 10 or d[0] == "1") else (None, d)
    if lead is None:
        if not m.startswith("+") or not 8 <= len(d) <= 15:
            return None
        return _refill(m, d[:2] + f"{f.permute(int(d[2:]), 10 ** (len(d) - 2), 'phone' + d[:2], back):0{len(d) - 2}d}")
    if d[0] in "01" or d[3] in "01":
        # no number of the plan, but somebody's all the same: it keeps to the rest of the ten-digit numbers
        rest = lambda v: (s := f"{v:010d}")[0] in "01" or s[3] in "01"
        return _refill(m, lead + f"{f.permute(int(d), 10**10, 'phone10', back, rest):010d}")
    x = (int(d[:3]) - 200) * 8_000_000 + (int(d[3:6]) - 200) * 10_000 + int(d[6:])
    y = f.permute(x, 800 * 8_000_000, "phone", back)
    return _refill(m, lead + f"{y // 8_000_000 + 200}{y // 10_000 % 800 + 200}{y % 10_000:04d}")


def _ipv4(m: str, f: Feistel, back: bool) -> str | None:
    parts = [int(p) for p in m.split(".")]
    if len(parts) != 4 or max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m.split(".")):
        return None
    y = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4", back)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _ssn(m: str, f: Feistel, back: bool) -> str | None:
    ok = lambda a, g, s: 0 < a < 900 and a != 666 and g > 0 and s > 0
    a, g, s = (int(p) for p in m.split("-"))
    if not ok(a, g, s):
        return None
    y = f.permute(a * 1_000_000 + g * 10_000 + s, 10**9, "ssn", back, lambda v: ok(v // 1_000_000, v // 10_000 % 100, v % 10_000))
    return f"{y // 1_000_000:03d}-{y // 10_000 % 100:02d}-{y % 10_000:04d}"


_LOW, _HIGH, _LAST = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal(), date.max.toordinal()


def _date(m: str, f: Feistel, back: bool) -> str | None:
    sep = next(c for c in m if not c.isdigit())
    p = m.split(sep)
    y, mo, d = p if len(p[0]) == 4 else p[::-1]
    swapped = False
    try:
        day = date(int(y), int(mo), int(d)).toordinal()
    except ValueError:
        if len(p[0]) == 4:
            return None
        try:
            day, swapped = date(int(y), int(d), int(mo)).toordinal(), True
        except ValueError:
            return None
    # a day above 12 shows which of the two layouts was meant; that stays so
    amb = lambda o: len(p[0]) != 4 and date.fromordinal(o).day > 12
    # dates of 1900 to 2099 are a domain of their own, the days before and after them another; neither is walked for the other's sake
    plain = _HIGH - _LOW
    if _LOW <= day < _HIGH:
        x, size, place = day - _LOW, plain, lambda v: v + _LOW
    else:
        x, size, place = day - 1 - (plain if day >= _HIGH else 0), _LAST - plain, lambda v: v + 1 + (plain if v + 1 >= _LOW else 0)
    new = date.fromordinal(place(f.permute(x, size, f"date{swapped}", back, lambda v: not swapped or amb(place(v)))))
    if len(p[0]) == 4:
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}" if swapped else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(s: str, f: Feistel, tweak: str, back: bool, alphabets: tuple[str, ...] = _ALPHABETS, valid: Callable[[str], bool] | None = None) -> str:
    """Permute *s* among the *valid* strings with the same alphabet at each place; other characters stay."""
    of = {c: a for a in alphabets for c in a}
    places = [(i, of[c]) for i, c in enumerate(s) if c in of]
    x, n = 0, 1
    for i, a in places:
        x, n = x * len(a) + a.index(s[i]), n * len(a)

    def text(y: int) -> str:
        out = list(s)
        for i, a in reversed(places):
            y, r = divmod(y, len(a))
            out[i] = a[r]
        return "".join(out)

    return text(f.permute(x, n, tweak + ":" + "".join(str(alphabets.index(of[c])) if c in of else c for c in s), back, (lambda y: valid(text(y))) if valid else lambda _: True))


def _email(m: str, f: Feistel, back: bool) -> str | None:
    local, _, domain = m.rpartition("@")
    return _classes(local, f, "mail", back) + "@" + domain


def _access_key(m: str, f: Feistel, back: bool) -> str | None:
    return m[:4] + _classes(m[4:], f, "key", back, (_ALPHABETS[2] + _ALPHABETS[0],))


def _secret(m: str, f: Feistel, back: bool) -> str | None:
    k = re.match(r"""[a-zA-Z_-]+\s*[=:]\s*["']?""", m).end()
    # each value keeps to its kind, so that the way back reads it alike: lower-case hex with plain digits, upper-case hex, others
    kind = lambda v: "hex" if re.fullmatch("[0-9a-f]+", v) else "HEX" if re.fullmatch("[0-9A-F]+", v) else ""
    own = kind(m[k:])
    alphabets = {"hex": ("0123456789abcdef",), "HEX": ("0123456789ABCDEF",)}.get(own, _ALPHABETS)
    return m[:k] + _classes(m[k:], f, "secret" + own.replace("hex", ""), back, alphabets, lambda v: kind(v) == own)


_SEP = r"[ -]?"
_KINDS: tuple[tuple[str, str, Callable[[str, Feistel, bool], str | None]], ...] = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b", _email),
    ("secret", r"""\b(?i:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*["']?[A-Za-z0-9+/_-]{8,}""", _secret),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _access_key),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("date", r"(?<![\w.])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?!\w|[.-][0-9])", _date),
    ("ipv4", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ipv4),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("card", rf"(?<![\w+])[0-9](?:{_SEP}[0-9]){{12,18}}(?![\w])", _card),
    ("phone", r"(?<![\w])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?!\w)|\+[0-9](?:[ .-]?[0-9]){7,14}(?!\w)", _phone),
)
_PATTERNS = [(name, re.compile(p), fn) for name, p, fn in _KINDS]
_MAYBE = r"[0-9@]|(?i:password|passwd|secret|token|api_key|apikey)\s*[=:]"


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of values that look like one of the kinds, before validation; they may overlap."""
    has_digit = re.search(r"[0-9]", text) is not None
    spans = []
    for name, p, _ in _PATTERNS:
        if name == "email":
            if "@" in text:
                spans += [(m.start(), m.end(), name) for m in p.finditer(text)]
        elif has_digit or name == "secret":
            spans += [(m.start(), m.end(), name) for m in p.finditer(text)]
    return sorted(spans, key=lambda s: s[0])


_FN = {name: fn for name, _, fn in _KINDS}


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, int]:
    """The text with each validated value replaced, and how many were; *back* restores the original."""
    out, at, n = [], 0, 0
    for a, b, kind in find(text):
        if a < at:
            continue
        new = _FN[kind](text[a:b], f, back)
        if new is not None:
            out += [text[at:a], new]
            at, n = b, n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


def pseudonymise_documents(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """*docs* with the text replaced and n_pii appended; one map over Arrow batches, no shuffle."""
    kept = [c for c in docs.columns if c.lower() != "n_pii"]
    src = docs.select(*[docs[f"`{c}`"].cast("string").alias(c) if c.lower() == text_col.lower() else docs[f"`{c}`"] for c in kept])
    place = [c.lower() for c in kept].index(text_col.lower())
    schema = T.StructType([*src.schema.fields, T.StructField("n_pii", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            text = batch.column(place)
            maybe = pc.fill_null(pc.match_substring_regex(text, _MAYBE), False)
            at = pc.indices_nonzero(maybe).to_pylist()
            texts, n = text.to_pylist() if at else None, [0] * len(text)
            for i in at:
                texts[i], n[i] = pseudonymise(texts[i], f)
            cols = list(batch.columns)
            if at:
                cols[place] = pa.array(texts, text.type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], names=schema.names)

    return src.mapInArrow(run, schema)
