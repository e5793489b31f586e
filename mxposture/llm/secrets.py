"""Secrets by form and by randomness, in DataFrame functions only.

By form: assignments to a secret's name, access key ids, long hexadecimal runs.

By randomness: a token of at least ``SHORTEST`` characters gets an encoding (hexadecimal, base 32, base
36 in one case, base 64; plain numbers are no secrets) from the characters it uses, and three measures
over that alphabet:

    chi      chi-squared distance of the symbol counts from uniform (base 64: of the cases, too)
    runs     runs of symbols in the upper and lower half of the alphabet (base 36, which also
             takes letters of one case alone: of letters and of digits, since words mix the halves)
    serial   correlation of each symbol with the next

Each is compared with two hypotheses. A token that even pure chance would hardly make so uneven
(beyond ``NOT_RANDOM`` deviations) is no secret. For the others the three deviations from what
written tokens (identifiers, dates, words with numbers) show are added to one z; long tokens give
more evidence, so z grows with length by itself. Which z count is decided by Benjamini-Hochberg at
rate ``RATE`` within each length class, over all tokens of the corpus, from counts of z in steps of
1/100; a handful of class limits is all that reaches the driver.

Cases: a null or empty text has no spans. Offsets count code points, ends are exclusive. Equal rows
get equal spans. No documents: an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import bound, empty_text, masked, prefixes, settled

FORMS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    # A maximal run of fewer than 32 is dropped, so only runs of 32 have to be found.
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
KINDS = [*FORMS, "random"]
SHORTEST = 16
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"

#: Alphabets in the order of their symbols' values.
HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: What written tokens show: excess of sum(p^2) * symbols over 1, share of changes between the
#: halves of the alphabet, correlation of neighbours, share of digits in base 36.
UNEVEN = {16: 1.2, 32: 1.5, 36: 1.5, 64: 3.0}
CHANGES = 0.25
SERIAL = 0.35
DIGITS = 0.1
NOT_RANDOM = 3.0
RATE = 0.01
CLASSES = (16, 24, 40, 80)
_FAR = 2**31 - 1


def found_spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
        before = prefixes(sizes, lambda a, x: a + x)
        spans = F.zip_with(
            pieces,
            before,
            lambda p, at: F.struct(
                F.lit(kind).alias("kind"),
                (at + F.length(p["gap"])).alias("start"),
                (at + F.length(p["gap"]) + F.length(p["match"])).alias("end"),
                p["value"].alias("value"),
            ),
        )
        return F.filter(spans, lambda s: F.coalesce(F.length(s["value"]) >= least, F.lit(False)))

    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), bound(pieces, placed)).otherwise(nothing)


def _sums(value: Column, alphabet: str) -> Column:
    """Over the places of the symbols in the alphabet: sum, squares, neighbour products, first, last."""
    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(c) for c in ("sum", "squares", "products", "first", "last")])

    def step(a: Column, c: Column) -> Column:
        x = F.instr(F.lit(alphabet), c).cast("long")
        return F.struct(
            (a["sum"] + x).alias("sum"),
            (a["squares"] + x * x).alias("squares"),
            (a["products"] + a["last"] * x).alias("products"),
            F.when(a["first"] == 0, x).otherwise(a["first"]).alias("first"),
            x.alias("last"),
        )

    return F.aggregate(F.split(value, ""), start, step)


def _measures(value: Column, alphabet: str) -> Column:
    """What the tests read from a token, each found in one pass: a struct of doubles."""
    k = len(alphabet)
    by_half, by_digit = "0" * (k // 2) + "1" * (k // 2), "".join("0" if c.isdigit() else "1" for c in alphabet)
    halves = F.translate(value, alphabet, by_digit if k == 36 else by_half)
    counts = F.transform(
        F.array_distinct(F.split(value, "")), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))
    )
    return F.struct(
        F.length(value).cast("double").alias("n"),
        F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c).alias("squares"),
        F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double").alias("ones"),
        (F.length(F.regexp_replace(halves, r"(.)\1+", "$1")) - 1.0).alias("changes"),
        F.length(F.regexp_replace(value, "[^a-z]+", "")).cast("double").alias("lower"),
        _sums(value, alphabet).alias("sums"),
    )


def _z_of(m: Column, k: int) -> Column:
    """z of a token with these measures; null where chance alone would not make it."""
    n, ones, changes, sums = m["n"], m["ones"], m["changes"], m["sums"]
    chi = m["squares"] * k / n - n
    mean = sums["sum"] / n
    spread = sums["squares"] - mean * sums["sum"]
    products = sums["products"] - mean * (2 * sums["sum"] - sums["first"] - sums["last"]) + (n - 1) * mean * mean
    # A token of one symbol has no spread.
    serial = F.when(spread > 1e-9 * sums["squares"], products / spread).otherwise(1.0)

    by_chance = 2.0 * ones * (n - ones) / n
    usual = [
        (chi - (k - 1)) / (2.0 * (k - 1)) ** 0.5,
        F.abs(changes - by_chance) / F.sqrt(F.greatest(n - 1, F.lit(1.0)) / 4),
        F.abs(serial) * F.sqrt(n),
    ]
    if k == 64:
        # Counting upper and lower case apart hides how few capitals a written token has.
        usual.append(F.abs(m["lower"] - n * 26 / 64) / F.sqrt(n * (26 / 64) * (38 / 64)))
    if k == 36:
        usual.append(F.abs(ones - n * 26 / 36) / F.sqrt(n * (26 / 36) * (10 / 36)))
    gain = UNEVEN[k]
    third = (SERIAL - serial) * F.sqrt(n)
    if k == 36:
        # Neighbouring letters of words do not go together in this order, but words have few digits.
        third = (n * (1 - DIGITS) - ones) / F.sqrt(n * DIGITS * (1 - DIGITS))
    z = (
        (k - 1 + n * gain - chi) / F.sqrt(2.0 * (k - 1) + 4.0 * n * gain)
        + (changes - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
        + third
    ) / 3**0.5
    return F.when(F.greatest(*usual) <= NOT_RANDOM, z)


def _random_z(value: Column, alphabet: str) -> Column:
    return bound(_measures(value, alphabet), lambda m: _z_of(m, len(alphabet)))


def scored_token(value: Column) -> Column:
    """z of a token over the alphabet that its characters fit, null where it fits none."""

    def scored(plain: Column) -> Column:
        return (
            F.when(plain.rlike("^[0-9]+$"), F.lit(None).cast("double"))
            .when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), bound(F.lower(plain), lambda p: _random_z(p, HEX)))
            .when(plain.rlike("^[A-Z2-7]+$") & plain.rlike("[2-7]"), _random_z(plain, BASE32))
            .when(plain.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), bound(F.lower(plain), lambda p: _random_z(p, BASE36)))
            .when(plain.rlike("^[A-Za-z0-9+/]{16,}$") & plain.rlike("[a-z]") & plain.rlike("[A-Z]"), _random_z(plain, BASE64))
        )

    return bound(F.rtrim(F.translate(value, "-_", "+/"), F.lit("=")), scored)


def length_class(value: Column) -> Column:
    out = F.lit(CLASSES[0])
    for low in CLASSES[1:]:
        out = F.when(F.length(value) >= low, F.lit(low)).otherwise(out)
    return out


def proposals(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of ``keep``), ``base`` (spans by form) and ``tokens`` (span, class and z).

    z is in steps of 1/100. The kept columns travel inside one struct, so no name can clash.
    """
    value = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("row"), empty_text(text).alias("text"))
    rows = rows.select(
        "row",
        F.array(*[found_spans(value, *form, kind) for kind, form in FORMS.items()]).alias("by_form"),
        found_spans(value, TOKEN, 0, SHORTEST, "random").alias("found"),
    )
    tokens = F.transform(
        "found",
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            length_class(t["value"]).alias("size"),
            F.floor(scored_token(t["value"]) * 100).cast("int").alias("z"),
        ),
    )
    base = F.transform(
        F.flatten("by_form"),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.select("row", base.alias("base"), tokens.alias("tokens"))


def limits(proposed: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length class the least z (in steps) that Benjamini-Hochberg accepts, if any."""
    tokens = proposed.select(F.explode("tokens").alias("t")).select("t.size", "t.z")
    bins = tokens.groupBy("size", "z").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("size").orderBy(F.desc_nulls_last("z"))
    ranked = bins.withColumns(
        {"rank": F.sum("n").over(above), "all": F.sum("n").over(Window.partitionBy("size"))}
    ).where("z > 0")
    # Upper tail of the normal law, to a third of a percent of itself.
    z = F.col("z") / 100.0
    tail = F.exp(-z * z / 2) / (2.50662827 * (0.661 * z + 0.339 * F.sqrt(z * z + 5.51)))
    accepted = ranked.where(tail * F.col("all") <= rate * F.col("rank"))
    return {r["size"]: r["z"] for r in accepted.groupBy("size").agg(F.min("z").alias("z")).collect()}


def accepted_spans(least: dict[int, int]) -> Column:
    """The base spans and the tokens beyond their limit that touch none, by start, then kind."""
    base = F.col("base")

    def passes(token: Column) -> Column:
        out = F.lit(False)
        for size, z in sorted(least.items()):
            out = out | ((token["size"] == size) & F.coalesce(token["z"] >= z, F.lit(False)))
        return out

    kinds = F.array(*map(F.lit, KINDS))

    def entry(s: Column, kind: Column, wanted: Column) -> Column:
        order = F.array_position(kinds, kind)
        return F.struct(s["start"].alias("start"), order.alias("order"), kind.alias("kind"), s["end"].alias("end"), wanted.alias("wanted"))

    entries = F.array_sort(
        F.concat(
            F.transform(base, lambda s: entry(s, s["kind"], F.lit(True))),
            F.transform("tokens", lambda t: entry(t, F.lit("random"), passes(t))),
        )
    )

    def apart(found: Column) -> Column:
        """Tokens that neither an earlier nor a later base span reaches into."""
        is_base = lambda s: s["kind"] != "random"
        ends = F.transform(found, lambda s: F.when(is_base(s), s["end"]).otherwise(0))
        back = F.transform(F.reverse(found), lambda s: F.when(is_base(s), _FAR - s["start"]).otherwise(0))
        before = prefixes(ends, lambda a, x: F.greatest(a, x))
        after = F.reverse(prefixes(back, lambda a, x: F.greatest(a, x)))
        return F.zip_with(
            found,
            F.arrays_zip(before.alias("before"), after.alias("after")),
            lambda s, near: F.when(
                is_base(s) | (s["wanted"] & (near["before"] <= s["start"]) & (_FAR - near["after"] >= s["end"])),
                F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
            ),
        )

    return F.array_compact(bound(entries, apart))


def scanned(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``spans`` (kind, start, end)."""
    proposed = settled(proposals(docs, keep, text))
    return proposed.select("row.*", accepted_spans(limits(proposed)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets.

    The corpus is scanned twice, once for the limits and once for the texts, so that no text is
    written between the two.
    """
    least = limits(proposals(docs, [], text))
    found = proposals(docs, docs.columns, text).withColumn("spans", accepted_spans(least))
    value = F.col("row")[text]
    clean = F.when(F.size("spans") > 0, masked(value, F.col("spans"))).otherwise(value)
    columns = [clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)
