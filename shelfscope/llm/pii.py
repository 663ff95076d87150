"""Pseudonyms for personal data: validated values are permuted within their format under a key.

Kinds: e-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), national
numbers of the form ddd-dd-dddd, phone numbers, calendar dates, and secrets (access keys and
tokens, long hexadecimal tokens, values after ``password=`` or ``password:`` in any case). A value is replaced by another of the
same format: same length, classes and separators, with check digits recomputed and dates
that exist. The permutation is a Feistel network over the numbers of the format's domain,
walked until it falls inside; it is one-to-one, so equal values get equal pseudonyms in
all documents and different ones stay different. Digits alone decide, not separators.
As in any permutation a value may be its own pseudonym, by a chance of one in its domain.

Texts without such values come back unchanged. Null text: null, no replacement. Repeated
rows: the same result. Very long texts and values are read whole, in linear time. An extra
column `replaced` gives way to the result's; others are kept. Ties do not arise: of values
that overlap, the earlier kind wins. Empty table: no rows.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b, shake_256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, walked while outside."""
    if size <= 1:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            seed = blake2b(right.to_bytes(width, "big") + bytes([r]) + tweak.encode(), key=key, digest_size=8).digest()
            stream = seed if width <= 8 else b"".join(
                blake2b(seed + k.to_bytes(4, "big"), key=key, digest_size=64).digest() for k in range(-(-width // 64)))
            left, right = right, left ^ (int.from_bytes(stream[:width] if width <= 8 else stream, "big") & mask)
        x = left << half | right
        if x < size:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


#: Digits and letters up to which a value is permuted as one number.
TOGETHER = 128


def _long_text(value: str, key: bytes, tweak: str, member: dict[str, str], shape: str) -> str:
    """A Feistel network over the two halves of a long value: each half in turn is shifted, character by character
    within its class, by a keyed stream that the other half gives. One-to-one, in linear time."""
    codes, top = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4"), max(map(ord, member)) + 1
    sizes, places, letters = np.zeros(top, np.int64), np.zeros(top, np.int64), np.zeros((top, max(map(len, member.values()))), "<u4")
    for c, cls in member.items():
        sizes[ord(c)], places[ord(c)], letters[ord(c), : len(cls)] = len(cls), cls.index(c), [*map(ord, cls)]
    at = np.flatnonzero(codes < top)
    at = at[sizes[codes[at]] > 0]
    size, digit = sizes[codes[at]], places[codes[at]]
    half, about = len(at) // 2, blake2b((tweak + shape).encode(), key=key).digest()
    for r in range(ROUNDS):
        mine, other = (slice(0, half), slice(half, None)) if r % 2 else (slice(half, None), slice(0, half))
        stream = shake_256(about + bytes([r]) + digit[other].astype(np.uint8).tobytes()).digest(4 * len(digit[mine]))
        digit[mine] = (digit[mine] + np.frombuffer(stream, "<u4")) % size[mine]
    out = codes.copy()
    out[at] = letters[codes[at], digit]
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def permuted_text(value: str, key: bytes, tweak: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Every digit and letter of the value permuted together, each within its class; other characters stay."""
    member = {c: cls for cls in classes for c in cls}
    shape = value.translate({ord(c): {10: "9", 26: "a", 16: "f"}[len(cls)] for c, cls in member.items()})
    if sum(map(member.__contains__, value)) > TOGETHER:
        return _long_text(value, key, tweak, member, shape)
    x, size = 0, 1
    for c in value:
        if c in member:
            x, size = x * len(member[c]) + member[c].index(c), size * len(member[c])
    y = permuted(x, size, key, tweak + shape)
    out = []
    for c in reversed(value):
        if c in member:
            y, digit = divmod(y, len(member[c]))
            out.append(member[c][digit])
        else:
            out.append(c)
    return "".join(reversed(out))


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _into(shape: str, digits: str, member: Callable[[str], bool] = str.isdigit) -> str:
    """The shape with its characters of the class replaced in order."""
    new = iter(digits)
    return "".join(next(new) if member(c) else c for c in shape)


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def card(value: str, key: bytes) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = permuted_text(d[:-1], key, "card")
    return _into(value, body + str((10 - luhn(body + "0")) % 10))


_GROUP = re.compile(r"\d+")
#: Digits in the groups of a card number as it is printed; one group of 13 to 19 is one too.
_PRINTED = re.compile(r"(4 4 4 (?:4 [123]|[1234])|4 6 [45]|1[3-9])(?= )")


def cards(text: str, start: int, end: int, key: bytes) -> Iterator[tuple[int, int, str]]:
    """The card numbers of a run of digits: the run itself, else groups of it as cards are printed, else its
    longest part that is one; other numbers (expiry, security code, order) may stand beside them."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    if re.match(r"[\w-]", text[end : end + 1], re.ASCII):
        groups.pop()  # the last digits belong to a word

    def number(first: int, last: int) -> tuple[int, int, str] | None:
        a, b = groups[first][0], groups[last - 1][1]
        new = card(text[a:b], key) if b - a <= 40 else None
        return new and (a, b, new)

    if groups and (found := number(0, len(groups))):
        yield found
        return
    k, some = 0, False
    while k < len(groups):
        sizes = "".join(f"{b - a} " for a, b in groups[k : k + 5])
        shape = _PRINTED.match(sizes)
        n = 1 + shape[1].count(" ") if shape else 0
        # a fifth group may be the number's or stand beside it
        found = next((x for m in ((n, n - 1) if n == 5 else (n,)) if m and (x := number(k, k + m))), None)
        if found:
            some = True
            yield found
            k = next((j for j in range(k, len(groups)) if groups[j][1] >= found[1])) + 1
        else:
            k += 1
    first = 0
    while not some and first < len(groups):
        last, digits, ends = first, 0, []
        while last < len(groups) and (digits := digits + groups[last][1] - groups[last][0]) <= 19:
            last += 1
            ends += [last] if digits >= 13 else []
        hit = next(((x, e) for e in reversed(ends) if (x := number(first, e))), None)
        if hit:
            yield hit[0]
        first = hit[1] if hit else max(last, first + 1)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permuted_text(plain[4:], key, "iban" + plain[:2])
    check = 98 - _mod97(plain[:2] + "00" + body)
    return _into(value, f"{plain[:2]}{check:02d}{body}", str.isalnum)


#: Characters of an IBAN by country, from the SWIFT registry.
_IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}


def ibans(text: str, start: int, end: int, key: bytes) -> Iterator[tuple[int, int, str]]:
    """The IBAN of a run of groups: up to the country's length, else the longest part that is one."""
    ends = [end, *(k for k in range(end - 1, start, -1) if text[k] == " ")]
    size = _IBAN_LENGTHS.get(text[start : start + 2])
    ends.sort(key=lambda e: len(text[start:e].replace(" ", "")) != size)
    # A shorter part of another length than the country's is none.
    for e in ends if size is None else [e for e in ends if e == end or e == ends[0]]:
        if (new := iban(text[start:e], key)) is not None:
            yield start, e, new
            return


def address(value: str, key: bytes) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    n = int.from_bytes(bytes(parts), "big")
    y = permuted(n, 1 << 32, key, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def mail(value: str, key: bytes) -> str | None:
    local, _, domain = value.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{permuted_text(f'{local}@{name}'.lower(), key, 'mail' + top.lower())}.{top}"


# The calling codes of two digits; 1 and 7 stand alone, all others have three.
_CALLING = frozenset("""20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
    81 82 84 86 90 91 92 93 94 95 98""".split())


def phone(value: str, key: bytes) -> str | None:
    """An international number keeps its calling code, however its digits are grouped."""
    d = _digits(value)
    if not 7 <= len(d) <= 15:
        return None
    kept = "" if value[0] != "+" else d[:1] if d[0] in "17" else d[:2] if d[:2] in _CALLING else d[:3]
    return _into(value, kept + permuted_text(d[len(kept) :], key, "phone"))


def national(value: str, key: bytes) -> str | None:
    return _into(value, permuted_text(_digits(value), key, "national"))


_ERAS = ((dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()), (dt.date(1000, 1, 1).toordinal(), dt.date(9999, 12, 31).toordinal()))


def date(value: str, key: bytes) -> str | None:
    """Days of 1900 to 2099 are permuted among themselves, others among the years of four digits."""
    parts = re.split(r"[-/.]", value)
    sep = value[len(parts[0])]
    year_first = len(parts[0]) == 4
    y, a, b = (parts[0], parts[1], parts[2]) if year_first else (parts[2], parts[1], parts[0])
    swapped = False
    try:
        day = dt.date(int(y), int(a), int(b))
    except ValueError:
        try:
            day, swapped = dt.date(int(y), int(b), int(a)), True
        except ValueError:
            return None
    n = day.toordinal()
    first, last = _ERAS[0] if _ERAS[0][0] <= n <= _ERAS[0][1] else _ERAS[1]
    while True:
        n = first + permuted(n - first, last - first + 1, key, "date")
        if first != _ERAS[1][0] or not _ERAS[0][0] <= n <= _ERAS[0][1]:
            break
    new = dt.date.fromordinal(n)
    pad = lambda x, old: f"{x:0{len(old)}d}" if old.startswith("0") or len(old) == 2 else str(x)
    month, d = (pad(new.month, b), pad(new.day, a)) if swapped else (pad(new.month, a), pad(new.day, b))
    second, third = (d, month) if swapped else (month, d)
    return sep.join([f"{new.year:04d}", second, third] if year_first else [third, second, f"{new.year:04d}"])


def secret(value: str, key: bytes) -> str | None:
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    if hexadecimal:
        digits = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        return permuted_text(value, key, "hex", (digits,))
    head = "AKIA" if value.startswith("AKIA") else ""
    return head + permuted_text(value[len(head) :], key, "secret")


_NAMED = ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey")
#: Prefixes of access tokens, which stay.
_TOKENS = ("ghp_", "gho_", "sk_live_", "sk_test_", "xoxb-")

#: Kind, what (or one of what) the text must hold for it, pattern of the value (group 1), and its pseudonym. Earlier kinds come first.
KINDS: list[tuple[str, str | tuple[str, ...], str, Callable[[str, bytes], str | None]]] = [
    ("email", "@", r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", mail),
    ("secret", "AKIA", r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])", secret),
    ("secret", _TOKENS, rf"(?<![A-Za-z0-9])(?:{'|'.join(_TOKENS)})([A-Za-z0-9]{{16,}})(?![A-Za-z0-9])", secret),
    ("secret", _NAMED, rf"(?i:{'|'.join(_NAMED)})[\"']?\s*[=:]\s*[\"']?(?=[A-Za-z0-9_.!-]{{8}})([A-Za-z0-9](?:[A-Za-z0-9_.!-]*[A-Za-z0-9!])?)(?![A-Za-z0-9])", secret),
    ("secret", "", r"(?<![A-Za-z0-9])((?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,})(?![A-Za-z0-9])", secret),
    ("iban", "", r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    ("ip", ".", r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d]|\.\d)", address),
    ("date", "", r"(?<![\w./-])(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?:(?=[Tt]\d\d)|(?![\w/-]|\.\d))", date),
    ("card", "", r"(?<![\w.])(\d(?:[ -]?\d){12,}+)", card),
    ("national", "-", r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])", national),
    ("phone", "", r"(?<![\w+.-])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])", phone),
]
_COMPILED = [(kind, hint, re.compile(pattern, re.ASCII), change) for kind, hint, pattern, change in KINDS]
#: Kinds whose pattern may take more than the value: where in it the values are.
_WITHIN = {"card": cards, "iban": ibans}
_MARK = re.compile(rf"[0-9@]|AKIA|{'|'.join(_TOKENS)}|(?i:{'|'.join(_NAMED)})")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with its values replaced, and for each the kind and its place in the new text."""
    if not _MARK.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    folded = text.lower()
    for kind, hint, pattern, change in _COMPILED:
        if not any(h in (folded if hint is _NAMED else text) for h in ((hint,) if isinstance(hint, str) else hint)):
            continue
        new_ones = []
        at = 0
        while m := pattern.search(text, at):
            start, end = m.span(1)
            values = _WITHIN[kind](text, start, end, key) if kind in _WITHIN else [(start, end, m[1])]
            at = start + 1 if kind == "iban" else max(end, m.end())
            for start, end, new in values:
                # the neighbours in the sorted list of earlier kinds must not overlap
                k = bisect_left(found, (end,))
                if not (k and found[k - 1][1] > start) and (new := new if kind in _WITHIN else change(new, key)) is not None:
                    new_ones.append((start, end, kind, new))
                    at = max(at, end)
        if new_ones:
            found = sorted(found + new_ones)
    out, places, at, length = [], [], 0, 0
    for start, end, kind, new in found:
        out += [text[at:start], new]
        length += start - at + len(new)
        places.append({"kind": kind, "start": length - len(new), "end": length})
        at = end
    return "".join([*out, text[at:]]), places


def pseudonyms(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """The rows with the text replaced, and `replaced`: kind, start and end of each pseudonym in it."""
    shape = pa.struct([("text", pa.string()), ("replaced", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def change(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            parts = []
            for k in range(0, len(whole), 256):
                rows = []
                for text in whole.slice(k, 256).to_pylist():
                    new, places = (None, []) if text is None else pseudonymise(text, key)
                    rows.append({"text": new, "replaced": places})
                parts.append(pa.array(rows, shape))
            yield pa.concat_arrays(parts) if parts else pa.array([], shape)

    udf = F.arrow_udf(change, "text string, replaced array<struct<kind: string, start: long, end: long>>")
    kept = [c for c in docs.columns if c not in (text_column, "replaced")]
    one = "_" + max([*kept, "found"], key=len)  # longer than any other name
    found = docs.select(*[F.col(f"`{c}`") for c in kept], udf(F.col(text_column)).alias(one))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{one}`.text").alias(text_column), F.col(f"`{one}`.replaced").alias("replaced"))
