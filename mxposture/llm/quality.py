"""Quality rules: word and line measures, and perplexity bands of a character 4-gram model.

The model is modified Kneser-Ney over characters, one per language, counted by Spark over all
documents: each task sends its distinct 4-grams once, the rest is grouping. Characters keep the
number of distinct 4-grams far below that of words, and no rare-word list has to be cut. A 4-gram is
four 16-bit symbols in a 64-bit number: lower-case code points, digits as one symbol, white space as
one, all beyond the basic plane as one, zero before the text.

For scoring, the costs (-ln p) lie in arrays sorted by a scrambled (language, 4-gram) with a
directory over the leading bits. What is broadcast at once is bounded by ``part_rows``: a larger
model is cut by hash, the documents are read once per part, and the partial sums are added. Every
4-gram of the corpus is in the model, so no part needs another.

Perplexity is per word: exp of a text's whole cost over its words. (Per character it hides what is
odd: strings of symbols after each word are costly once and cheap from then on.) Bands come from all
distinct texts that pass the base rules; distinct, because one text copied a million times says
nothing about what is usual. A text's deviation is its cost per word less its language's median, times
the root of its words, as the error of a mean shrinks. The core of a language and length class (powers of
two words) is its median and, on either side, its quartile; both lean on the whole language's by the
weight of ``CLASS_WEIGHT`` texts, so a class of few texts is judged much like its language and one of many
by itself, with one rule at every size. Distances from the core in units of its width are then counted over
all classes of the language, and a tail is cut where what a normal core would put there is at most
``RATE`` of what is there: nine of ten texts cut are no part of the core. Nothing is cut from tails that
only the core fills.

Cases: a null or empty text has no words and fails. A null language is a language of its own. A
language with few documents has wider cores, by the sampling error of its quartiles; where the quartiles
coincide no width is known and nothing is cut. Equal rows get equal verdicts. No documents: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, code_points, empty_text, per_text, prefixed, settled, slices
from mxposture.llm.words import SPACE, mixed, shingles, span_hashes, spans, within

ORDER = 4
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
RATE = 0.1
QUARTILE = 0.6745
CLASS_WEIGHT = 1000
WHOLE_LANGUAGE = -1
PART_ROWS = 8_000_000
HELD_GRAMS = 1_000_000
MANY_LANGUAGES = 10_000
STEP = 1000
DEVIATION_STEP = 20
FARTHEST = 10_000
DISTANCE_STEP = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_FOLD = np.arange(1 << 16, dtype=np.uint16)
for _i in range(1 << 16):
    if not 0xD800 <= _i < 0xE000:
        _low = chr(_i).lower()
        _FOLD[_i] = ord(_low) if len(_low) == 1 and ord(_low) < 1 << 16 else _i
_FOLD[0x30:0x3A] = 0x30
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0]] = 0x20
_FOLD[0] = 0xFFFD
BEYOND = 0xFFFE

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram that ends at each character, character places where the texts begin, with the end)."""
    points = code_points(data)
    n_texts = len(offsets) - 1
    counts = per_text((data & 0xC0) != 0x80, offsets)
    bounds = np.zeros(n_texts + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    symbols = np.where(points < 1 << 16, _FOLD[points & 0xFFFF], BEYOND).astype(np.uint64)
    padded = np.zeros(len(symbols) + (ORDER - 1) * n_texts, np.uint64)
    place = np.arange(len(symbols)) + np.repeat((ORDER - 1) * np.arange(1, n_texts + 1), counts)
    padded[place] = symbols
    key = padded[place]
    for k in range(1, ORDER):
        key |= padded[place - k] << np.uint64(16 * k)
    return key, bounds


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The word and line measures of each text."""
    n = len(offsets) - 1
    in_word = ~SPACE[data]
    starts, ends, owner = spans(in_word, offsets)
    hashes = within(span_hashes(data, starts, ends), owner)
    covered = np.zeros(len(starts) + 1, np.int64)
    windows, at = shingles(hashes, owner, REPEAT_WINDOW)
    if len(windows):
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    l_starts, l_ends, l_owner = spans(data != 0x0A, offsets)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=words_before[1:])
    full = words_before[l_ends] > words_before[l_starts]
    l_starts, l_ends, l_owner = l_starts[full], l_ends[full], l_owner[full]
    lines = within(span_hashes(data, l_starts, l_ends), l_owner)
    first = np.unique(lines, return_index=True)[1]
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(l_owner, minlength=n) - np.bincount(l_owner[first], minlength=n),
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
    }


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table of (lang long, text); one row per task and distinct 4-gram."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def sent(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = merged(parts)
            columns = [pa.array(np.full(len(keys), lang, np.int64)), pa.array(keys.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in slices(batches):
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            keys, bounds = grams(*byte_offsets(batch.column(1)))
            lang_of = np.repeat(langs, np.diff(bounds))
            for lang in np.unique(langs):
                found = np.unique(keys[lang_of == lang], return_counts=True)
                held.setdefault(int(lang), []).append(found)
                size += len(found[0])
            if size > HELD_GRAMS:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD_GRAMS // 2:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    return docs.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the discounts of an order, from how many grams occur once to four times."""
    n = counts.groupBy("lang").agg(
        *[F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    )
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        raw = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        usable = raw.isNotNull() & (raw > 0) & (raw < k)
        return F.when(usable, raw).otherwise(F.lit(k / 2)).alias(f"d{k}")

    return n.select("lang", discount(1), discount(2), discount(3))


def model(counts: DataFrame) -> DataFrame:
    """(lang, gram, cost): -ln of the interpolated modified Kneser-Ney probability."""
    levels = {ORDER: settled(counts)}
    for k in range(ORDER - 1, 0, -1):
        # Below the top a gram counts how many symbols stand before it; at the text's start its uses.
        at_start = F.shiftrightunsigned("gram", 16 * (k - 1)) == 0
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        grouped = (
            levels[k + 1]
            .groupBy("lang", shorter.alias("gram"))
            .agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("kinds"))
        )
        # Each level is read three times below.
        levels[k] = settled(
            grouped.select("lang", "gram", F.when(at_start, F.col("uses")).otherwise(F.col("kinds")).alias("n"))
        )
    lower = None
    for k in range(1, ORDER + 1):
        history = Window.partitionBy("lang", "history")
        drop = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = (
            levels[k]
            .join(_discounts(levels[k]), "lang")
            .withColumn("history", F.shiftrightunsigned("gram", 16))
            .withColumn("drop", drop)
            .withColumns(
                {
                    "total": F.sum("n").over(history),
                    "freed": F.sum("drop").over(history),
                    "symbols": F.count(F.lit(1)).over(history),
                }
            )
        )
        kept = (F.col("n") - F.col("drop")) / F.col("total")
        weight = F.col("freed") / F.col("total")
        if lower is None:
            p = kept + weight / (F.col("symbols") + 1)
            lower = rows.select("lang", "gram", p.alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", suffix).join(below, ["lang", "suffix"])
            lower = rows.select("lang", "gram", (kept + weight * F.col("below")).alias("p"))
    return lower.select("lang", "gram", (-F.log("p")).cast("float").alias("cost"))


class Costs:
    """Costs in arrays sorted by scrambled key, with a directory over the leading bits."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, cost: np.ndarray):
        hashes = self.hashed(lang.view(np.uint64), gram.view(np.uint64))
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.cost = np.append(cost[order], np.float32(0))
        self.shift = 64 - max(1, len(hashes).bit_length())
        heads = np.arange(1 << (64 - self.shift), dtype=np.uint64) << np.uint64(self.shift)
        self.directory = np.searchsorted(self.hashes[:-1], heads).astype(np.int64)

    @staticmethod
    def hashed(lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return mixed(gram ^ mixed(lang))

    def look_up(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The cost of each gram; 0 where this part of the model does not hold it."""
        wanted = self.hashed(lang, gram)
        at = self.directory[(wanted >> np.uint64(self.shift)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < wanted[behind]]
        return np.where(self.hashes[at] == wanted, self.cost[at], np.float32(0))


def scored(docs: DataFrame, costs, keep: list[str], lang: str, text: str) -> DataFrame:
    """``keep``, the measures and the whole cost of every row."""
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = docs.select(*keep).schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    schema = schema.add("cost", "double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = costs.value
        for batch in slices(batches, "_text"):
            data, offsets = byte_offsets(batch.column(batch.num_columns - 1))
            langs = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).view(np.uint64)
            found = measures(data, offsets)
            keys, bounds = grams(data, offsets)
            running = np.zeros(len(keys) + 1)
            np.cumsum(table.look_up(np.repeat(langs, np.diff(bounds)), keys), out=running[1:])
            columns = [batch.column(k) for k in range(len(fields))]
            columns += [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            columns.append(pa.array(running[bounds[1:]] - running[bounds[:-1]]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    code = F.xxhash64(F.coalesce(F.col(lang), F.lit("")))
    rows = docs.select(*keep, code.alias("_lang"), empty_text(text).alias("_text"))
    return rows.mapInArrow(measure, schema)


def perplexity(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(a row of ``keep`` with the text's language code and digest, its measures and cost a word).

    Rows with equal ``keep`` are equal in everything the caller sees; the result is settled.
    """
    spark = docs.sparkSession
    code = F.xxhash64(F.coalesce(F.col(lang), F.lit("")))
    trained = settled(model(gram_counts(docs.select(code.alias("lang"), empty_text(text).alias("text")))))
    parts = max(1, -(-trained.count() // part_rows))
    marked = docs.select(*keep, lang, text, *[c.alias(n) for n, c in digest(lang, text).items()])
    own = [*keep, *digest(lang, text)]
    results = []
    for k in range(parts):
        part = trained.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow().combine_chunks()
        costs = spark.sparkContext.broadcast(Costs(*[part.column(c).to_numpy() for c in ("lang", "gram", "cost")]))
        del part
        results.append(settled(scored(marked, costs, own, lang, text)))
        costs.destroy()
    rows = results[0]
    if parts > 1:
        whole = reduce(DataFrame.unionAll, results)
        # Each part holds every row once; equal rows have equal sums, so the count is divided again.
        rows = whole.groupBy(*own, *MEASURES).agg(
            F.sum("cost").alias("cost"), (F.count(F.lit(1)) / parts).cast("int").alias("_n")
        )
        rows = rows.withColumn("cost", F.col("cost") / F.col("_n"))
        rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return rows.withColumn("cost", F.try_divide("cost", "n_words")).withColumn(
        "base_failed", (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)
    )


def digest(lang: str, text: str) -> dict[str, Column]:
    """Columns that tell rows apart by language and text, the only things a verdict depends on."""
    return {
        "_lang_code": F.xxhash64(F.coalesce(F.col(lang), F.lit(""))),
        "_text_a": F.xxhash64(empty_text(text)),
        "_text_b": F.xxhash64(empty_text(text), F.lit(1)),
    }


def counted(values: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, bin, n, below, above, texts) with the shares at or beyond each bin."""
    bins = values.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("bin")
    placed = bins.withColumns({"upto": F.sum("n").over(upto), "texts": F.sum("n").over(Window.partitionBy(*by))})
    return placed.select(
        *by,
        "bin",
        "texts",
        (F.col("upto") / F.col("texts")).alias("below"),
        ((F.col("texts") - F.col("upto") + F.col("n")) / F.col("texts")).alias("above"),
    )


def quantile(share: float) -> Column:
    return F.min(F.when(F.col("below") >= share, F.col("bin")))


def cost_step() -> Column:
    return F.round(F.col("cost") * STEP).cast("long")


def length_class() -> Column:
    return F.floor(F.log2(F.col("n_words").cast("double"))).cast("int")


def deviation() -> Column:
    """How far the cost lies from its language's ``centre``, in steps."""
    far = F.round((cost_step() - F.col("centre")) * F.sqrt("n_words") * (DEVIATION_STEP / STEP))
    return F.greatest(F.least(far, F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("long")


def spread_out(table: DataFrame) -> DataFrame:
    """A settled table by language, broadcast if it is small: a join would send most rows to a few tasks."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= MANY_LANGUAGES else table


def centres(texts: DataFrame) -> DataFrame:
    """(language code, median cost in steps)."""
    steps = texts.select("_lang_code", cost_step().alias("bin"))
    return counted(steps, ["_lang_code"]).groupBy("_lang_code").agg(quantile(0.5).alias("centre"))


def cores(texts: DataFrame, centre: DataFrame) -> DataFrame:
    """(language code, class, core, width below, width above), in steps of the deviation."""
    by = ["_lang_code", "class"]
    values = texts.join(centre, "_lang_code").select(
        "_lang_code", F.explode(F.array(F.lit(WHOLE_LANGUAGE), length_class())).alias("class"), deviation().alias("bin")
    )
    found = counted(values, by).groupBy(*by).agg(F.first("texts").alias("texts"), *[quantile(p / 100).alias(f"q{p}") for p in (25, 50, 75)])
    found = found.select(*by, "texts", F.col("q50").alias("core"), (F.col("q50") - F.col("q25")).alias("down"), (F.col("q75") - F.col("q50")).alias("up"))
    # One row per language and class: the rows of a language are few.
    language = Window.partitionBy("_lang_code")
    weight = F.col("texts") / (F.col("texts") + CLASS_WEIGHT)
    total = F.max(F.when(F.col("class") == WHOLE_LANGUAGE, F.col("texts"))).over(language)

    def leaning(name: str) -> Column:
        whole = F.max(F.when(F.col("class") == WHOLE_LANGUAGE, F.col(name))).over(language)
        return weight * F.col(name) + (1 - weight) * whole

    # The sampling error of the quartiles, of as many texts as they lean on.
    error = (1 + 1 / F.sqrt(F.least(total, F.col("texts") + CLASS_WEIGHT))) / QUARTILE
    found = found.select(*by, leaning("core").alias("core"), (leaning("down") * error).alias("down"), (leaning("up") * error).alias("up"))
    return found.where(F.col("class") != WHOLE_LANGUAGE).withColumnRenamed("class", "_class")


def distance() -> Column:
    """The deviation's distance from the core in widths, in steps; 0 where no width is known."""
    off = deviation() - F.col("core")
    width = F.when(off < 0, F.col("down")).otherwise(F.col("up"))
    steps = F.round(F.coalesce(F.try_divide(off, width), F.lit(0.0)) * DISTANCE_STEP)
    return F.greatest(F.least(steps, F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("long")


def cuts(texts: DataFrame, centre: DataFrame, core: DataFrame) -> DataFrame:
    """(language code, least and greatest distance that stays)."""
    by = ["_lang_code"]
    values = texts.withColumn("_class", length_class()).join(centre, by).join(core, [*by, "_class"])
    placed = counted(values.select(*by, distance().alias("bin")), by)
    z = F.abs(F.col("bin")) / DISTANCE_STEP
    tail = F.exp(-z * z / 2) / (2.50662827 * (0.661 * z + 0.339 * F.sqrt(z * z + 5.51)))
    low = F.max(F.when((F.col("bin") < 0) & (tail <= RATE * F.col("below")), F.col("bin")))
    high = F.min(F.when((F.col("bin") > 0) & (tail <= RATE * F.col("above")), F.col("bin")))
    return placed.groupBy(*by).agg(
        F.coalesce(low + 1, F.lit(-FARTHEST)).alias("least"), F.coalesce(high - 1, F.lit(FARTHEST)).alias("most")
    )


def judged(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text", **more) -> DataFrame:
    """``keep``, the digest, the measures, ``perplexity``, ``lower``, ``upper`` and ``kept``."""
    rows = perplexity(docs, keep, lang, text, **more)
    texts = rows.where(~F.col("base_failed")).select(
        "_lang_code", "_text_a", "_text_b", "n_words", (cost_step() / STEP).alias("cost")
    )
    texts = settled(texts.distinct())
    centre = spread_out(centres(texts))
    core = spread_out(cores(texts, centre))
    cut = spread_out(cuts(texts, centre, core))
    placed = (
        rows.withColumn("_class", length_class())
        .join(centre, "_lang_code", "left")
        .join(core, ["_lang_code", "_class"], "left")
        .join(cut, "_lang_code", "left")
    )
    inside = (distance() >= F.col("least")) & (distance() <= F.col("most"))

    def border(end: str, width: str) -> Column:
        far = F.col("core") + F.col(end) / DISTANCE_STEP * F.col(width)
        return F.exp(F.col("centre") / STEP + far * F.try_divide(F.lit(1.0 / DEVIATION_STEP), F.sqrt("n_words")))

    return (
        placed.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))
        .withColumns({"lower": border("least", "down"), "upper": border("most", "up")})
        .withColumn("perplexity", F.exp("cost"))
        .drop("_class", "centre", "core", "down", "up", "least", "most")
    )


def good(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    rejected = judged(docs, [], lang, text).where(~F.col("kept")).select(*digest(lang, text)).distinct()
    own = {n: prefixed(docs.columns, n) for n in digest(lang, text)}
    marked = docs.withColumns({own[n]: c for n, c in digest(lang, text).items()})
    rejected = rejected.withColumnsRenamed(own)
    return marked.join(rejected, list(own.values()), "left_anti").select(*docs.columns)
