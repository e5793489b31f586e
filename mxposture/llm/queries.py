"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.llm import counts, decontam, elias, licenses, neardup, negatives, packing, periodic, pii, quality, repeats, secrets, sharding
from mxposture.llm.common import documents, joined, shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE, end_id=0, size=2048)


@query("op10_elias_fano_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    segments = elias.write_ids(documents(spark, sf_dir), path, WORD_BPE, end_id=1)
    rows = elias.documents_of(segments).join(elias.segment_starts(segments), "segment")
    return rows.select(
        F.col("key").alias("doc_id"), (F.col("base") + F.col("border")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op4_perplexity_bands")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(documents(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept", "perplexity", "lower", "upper")


_NEAR_COPIES = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.other)
SELECT id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id"""


@query("op7_minhash_coordinates", _NEAR_COPIES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.linked(documents(spark, sf_dir), width=2, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def number_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scanned(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))
    return rows.select(
        "doc_id", *map(number_of, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query("op8_randomness_battery")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(list(secrets.FORMS)))
    return rows.select(
        "doc_id", *map(number_of, secrets.FORMS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query("op3_benchmark_regions")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.found(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op1_hypergeometric_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    dealt = sharding.deal(rows, shards=24)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_licence_paragraphs")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir), ["doc_id"])


def edit_script():
    """Three edits that every document can take: an insertion, a removal and a replacement."""
    n = F.length("text")
    edits = [(n / 2, F.lit(0), F.concat(F.lit(" "), F.col("source"), F.lit(" "))), (n / 3, F.lit(40), F.lit(""))]
    edits.append((2 * n / 3, F.lit(10), F.lit("corrected passage, see above")))
    return F.array(
        *[
            F.struct(F.floor(start).alias("start"), remove.cast("long").alias("remove"), insert.alias("insert"))
            for start, remove, insert in edits
        ]
    )


@query("op9_edited_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("edits", edit_script())
    return counts.edited_counts(docs, ["doc_id"], BYTE_BPE)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents as op11 takes them: in one of ten, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # One-element arrays bind the words and the numbers once, not again for every word.
    found = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.floor(h / 10).alias("g")))
    placed = F.transform(found, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), x["g"].alias("g"), (x["g"] % x["n"]).alias("a")))
    turned = F.transform(
        placed, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + x["g"] % 8))).alias("p"))
    )

    def word(x, i):
        return F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))

    tails = F.transform(turned, lambda x: F.array_join(F.transform(x["w"], lambda _, i: word(x, i)), " "))
    changed = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn("text", F.when(changed, tails[0]).otherwise(F.col("text")))


_LEVELS = 18
_CRC = (
    "xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT)), "
    "lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295))"
)


def _run_sql() -> str:
    """Runs from the next place of an equal window: of 2^k words for periods from 2^(k-1) to 2^k."""
    levels = ["h0 AS (SELECT doc_id, i, n, hash(w) AS h FROM words)"]
    for k in range(1, _LEVELS):
        half = 2 ** (k - 1)
        levels.append(
            f"h{k} AS (SELECT x.doc_id, x.i, x.n, hash(x.h, y.h) AS h FROM h{k - 1} x JOIN h{k - 1} y ON y.doc_id = x.doc_id AND y.i = x.i + {half} WHERE 2 * x.n >= {3 * 2 ** k})"
        )
    islands = " UNION ".join(
        f"""SELECT doc_id, d, min(i) AS s, max(i) + d + {2 ** k} - min(i) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS grp FROM (
            SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS d FROM h{k}) WHERE d BETWEEN {max(1, 2 ** k // 2)} AND {2 ** k}) GROUP BY doc_id, d, grp"""
        for k in range(_LEVELS)
    )
    return f"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_CRC} AS h FROM documents),
  placed AS (SELECT doc_id, ws, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM docs),
  turned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
  words AS (SELECT doc_id, n, i, ws[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM turned)),
  {", ".join(levels)},
  runs AS (SELECT DISTINCT doc_id, s, len, d FROM ({islands}) WHERE len >= greatest(24, 3 * d)),
  best AS (SELECT doc_id, s, len, d, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / d DESC, s, d) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM runs),
  listed AS (SELECT doc_id, string_agg(s || ',' || len || ',' || d || chr(10), '' ORDER BY s, d) AS r FROM runs GROUP BY doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + d, s + len)) AS i FROM runs),
  kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT docs.doc_id, coalesce(c, 0) AS n_runs, s AS start, len AS length, d AS period, 1000 * len // d AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op11_periodic_runs", _run_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.with_runs(repeated_tails(documents(spark, sf_dir)), ["doc_id"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    greatest = F.aggregate(
        "runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", greatest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


_REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM x SEMI JOIN r USING (h)),
k AS (SELECT doc_id, count(*) AS c, string_agg(w, ' ' ORDER BY j) AS t FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d) ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


@query("op12_recompressed_repeats", _REPEATS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(documents(spark, sf_dir), ["doc_id"], width=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_NEGATIVES = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.id AS anchor_id, e.id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.id % 50 = 0 AND e.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


@query("op13_tree_negatives", _NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(documents(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
