"""Personal data: patterns propose, checksums confirm, words nearby adjust the score.

Every kind has a pattern, a validator that confirms or drops a match, a base score and words that
raise the score when they stand within ``NEAR`` characters. The four base kinds are reported as they
match and validate; the further kinds are reported from a score of ``LEAST`` on:

    iban       two letters, two digits, 11 to 30 letters or digits; mod-97 must be 1
    ssn        three, two and four digits; never 000, 666 or 9xx first, no zero group
    local      a national telephone number without a country code; needs a word nearby
    birth      a date; needs a word such as "born" nearby

The patterns are anchored where a run of their characters begins, which finds the same leftmost
matches and stays linear on runs of any length.

Cases: a null or empty text has no spans. Offsets count code points, ends are exclusive. Rows with
equal ids stay separate. No documents: an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from mxposture.llm.common import empty_text, slices

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn", "local", "birth"]
KINDS = BASE + ADDED
NEAR = 40
LEAST = 0.5
NEARBY = 0.35

_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(text: str) -> bool:
    joined = re.sub("[ ]", "", text)
    return int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ the local part is the run of its characters before."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            while start > free and text[start - 1] in _BEFORE_AT:
                start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest valid run of groups of each match: words in capitals may follow (a BIC, say)."""
    at = 0
    while match := _IBAN.search(text, at):
        start, end = match.span()
        # A country code, two digits and at least eleven more, as in the pattern.
        while sum(c != " " for c in text[start:end]) >= 15 and not mod97(text[start:end]):
            end = text.rfind(" ", start, end)
            if end < 0:
                break
        if end > start and sum(c != " " for c in text[start:end]) >= 15:
            yield start, end
            at = end
        else:
            at = start + 1


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _count(low: int, high: int, also: Callable[[str], bool] = lambda d: True) -> Callable[[str], bool]:
    def check(found: str) -> bool:
        digits = _DIGITS.sub("", found)
        return low <= len(digits) <= high and also(digits)

    return check


FINDERS: dict[str, tuple[Callable, Callable[[str], bool], float, str]] = {
    "email": (emails, lambda s: True, 0.9, "mail contact"),
    "ip": (
        _matches(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")),
        0.6,
        "ip address host server",
    ),
    "card": (_matches(r"(?<![0-9])[0-9](?:[ -]?[0-9])++"), _count(12, 19, luhn), 0.7, "card visa credit payment"),
    "phone": (_matches(r"\+[0-9][ ().0-9-]+[0-9]"), _count(9, 15), 0.7, "phone tel call mobile fax"),
    "iban": (
        ibans,
        mod97,
        0.9,
        "iban account bank",
    ),
    "ssn": (
        _matches(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
        lambda s: True,
        0.5,
        "ssn social security",
    ),
    "local": (
        _matches(r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
        lambda s: True,
        0.3,
        "phone tel call mobile fax",
    ),
    "birth": (
        _matches(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])"),
        lambda s: True,
        0.2,
        "born birth birthday dob",
    ),
}
_CONTEXT = {k: re.compile("|".join(rf"\b{w}" for w in f[3].split()), re.I) for k, f in FINDERS.items()}


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : start] + " \n " + text[end : end + NEAR]
    return min(1.0, FINDERS[kind][2] + NEARBY * bool(_CONTEXT[kind].search(around)))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind; added kinds only where no base span lies."""
    found = []
    has_digit = any(map(text.__contains__, "0123456789"))
    for number, kind in enumerate(KINDS):
        if not has_digit and kind != "email":
            continue
        finder, valid = FINDERS[kind][:2]
        for start, end in finder(text):
            if valid(text[start:end]):
                found.append((start, number, end, score(text, kind, start, end)))
    base = sorted((s, e) for s, n, e, _ in found if n < len(BASE))
    out, at, reached = [], 0, -1
    for start, number, end, points in sorted(found):
        while at < len(base) and base[at][0] < end:
            reached = max(reached, base[at][1])
            at += 1
        if number < len(BASE) or (reached <= start and points >= LEAST):
            out.append((KINDS[number], start, end, points))
    return out


SPANS = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("score", DoubleType()),
        ]
    )
)


def scanned(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``spans``, the personal data of every row."""
    rows = docs.select(*keep, empty_text(text).alias("_text"))
    schema = StructType([*rows.drop("_text").schema.fields, StructField("spans", SPANS)])
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [
                [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find(t)]
                for t in batch.column(batch.num_columns - 1).to_pylist()
            ]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*keep, "spans"])

    return rows.mapInArrow(scan, schema)
