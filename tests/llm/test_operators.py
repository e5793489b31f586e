"""The operators as Spark jobs: odd rows, empty tables, clashing names, and plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mxposture.llm import counts, decontam, elias, licenses, neardup, packing, pii, quality, queries, secrets, sharding
from mxposture.llm import components as component_steps
from mxposture.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the and of to in is it on as for with that this from by".split()


def prose(rng, n):
    made = ["".join(rng.choice(["an", "er", "ti", "on", "re", "st", "en", "th"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else w for w in made)


def table(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randrange(12, 120)), rng.choice(["en", "de"]), "s", 1) for k in range(n)]
    long = prose(rng, 30_000)
    rows += [
        (n, None, "en", "s", None),
        (n + 1, "", None, None, 0),
        (n + 2, "  \n\t ", "en", "s", 3),
        (n + 3, rows[3][1], "en", "s", 1),
        (n + 4, rows[3][1], None, "s", 1),
        (n + 5, long, "en", "s", len(long)),
        (n + 6, "x" * 50_000, "en", "s", 50_000),
        (n + 7, "one", "en", "s", 3),
        (None, rows[5][1], "en", "s", 1),
        rows[7],
        rows[7],
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(table(), SCHEMA)
    clash = ["text_", "_text", "shard", "slot", "row", "spans", "base", "_text_a", "node", "pair", "kept", "edits", "key"]
    return rows.withColumns({c: F.lit(k) for k, c in enumerate(clash)}).repartition(5).persist()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def rows_of(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


# --- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece_rows", [1_000_000, 4])
def test_shards_are_exact_and_gapless(odd, piece_rows):
    out = sharding.deal(odd, 7, piece_rows=piece_rows).persist()
    assert rows_of(out.drop("shard", "slot")) == rows_of(odd.drop("shard", "slot"))
    held = collections.defaultdict(list)
    for r in out.select("shard", "slot").collect():
        held[r.shard].append(r.slot)
    sizes = [len(held[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == odd.count()
    assert all(sorted(v) == list(range(len(v))) for v in held.values())


def test_shards_of_nothing(nothing):
    out = sharding.deal(nothing, 3)
    assert out.count() == 0 and {"shard", "slot"} <= set(out.columns)


def test_shuffle_is_uniform(spark):
    rows = spark.range(0, 4000, 1, 4)
    seen = collections.Counter((r.id // 1000, r.shard) for r in sharding.deal(rows, 4).collect())
    # 250 expected in each cell, with a deviation of 12; exact counts would mean no chance at all.
    assert all(abs(seen[a, b] - 250) < 60 for a in range(4) for b in range(4)) and len(set(seen.values())) > 1
    slots = [r.slot for r in sharding.deal(rows, 4).where("id < 1000").collect()]
    assert abs(sum(slots) / len(slots) - 499.5) < 40


def test_hypergeometric_frequencies(spark):
    n, good, drawn = 30, 12, 9
    draws = spark.range(20_000).select(
        sharding.hypergeometric(
            F.lit(good).cast("long"), F.lit(n).cast("long"), F.lit(drawn).cast("long"), sharding.uniform(F.lit(3), F.col("id"))
        ).alias("k")
    )
    from math import comb

    got = {r.k: r["count"] / 20_000 for r in draws.groupBy("k").count().collect()}
    for k in range(drawn + 1):
        want = comb(good, k) * comb(n - good, drawn - k) / comb(n, drawn)
        assert abs(got.get(k, 0) - want) < 0.015


# --- licences -------------------------------------------------------------------------------------


def test_licences_are_found_and_prose_is_not(spark, odd, nothing):
    rng = random.Random(2)
    notes = [(1000 + k, f"{prose(rng, 30)}\n{texts[0]}\n{prose(rng, 20)}", family) for k, (family, texts) in enumerate(licenses.NOTICES.items())]
    extra = spark.createDataFrame([(i, t) for i, t, _ in notes], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionAll(extra).unionAll(odd.select("doc_id", "text").where("doc_id < 60"))
    found = licenses.scanned(docs, ["doc_id"]).collect()
    got = {r.doc_id: r for r in found if r.confirmed}
    want = {i: family for i, _, family in notes}
    assert {i: r.family for i, r in got.items()} == want
    assert all(r.paragraph == 1 for r in got.values())
    assert all(r.doc_id >= 1000 for r in found)
    assert licenses.scanned(nothing, ["doc_id"]).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def test_leaks_are_found_with_their_places(spark, odd, nothing):
    rng = random.Random(5)
    items = [(k, prose(rng, 30)) for k in range(4)] + [(None, prose(rng, 30)), (9, None), (10, "short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    before = prose(rng, 40)
    changed = items[1][1].upper().replace(" ", "  ", 3)
    planted = [(500, f"{before}\n{items[0][1]}\nend"), (501, f"{before} {changed} {before}"), (502, items[4][1])]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    found = decontam.found(docs, benchmark, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(500, 0), (501, 1), (502, None)}
    whole = next(r for r in found if r.doc_id == 500)
    assert planted[0][1][whole.start : whole.end].strip() == items[0][1]
    clean = decontam.clean(odd, benchmark)
    assert clean.columns == odd.columns and rows_of(clean) == rows_of(odd)
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} & {500, 501, 502} == set()
    parts = decontam.found(docs, benchmark, ["doc_id"], part_chars=100).collect()
    assert sorted(map(str, parts)) == sorted(map(str, found))
    assert decontam.found(nothing, benchmark, ["doc_id"]).count() == 0
    assert decontam.found(docs, benchmark.limit(0), ["doc_id"]).count() == 0


# --- quality --------------------------------------------------------------------------------------


def plain_costs(texts):
    """Costs of a text under modified Kneser-Ney, straight from the definition."""
    order = quality.ORDER
    symbols = [[0] * (order - 1) + [int(x) for x in quality._FOLD[[ord(c) for c in t]]] for t in texts]
    top = collections.Counter(tuple(s[i - order + 1 : i + 1]) for s in symbols for i in range(order - 1, len(s)))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        made, uses = collections.Counter(), collections.Counter()
        for gram, n in levels[k + 1].items():
            made[gram[1:]] += 1
            uses[gram[1:]] += n
        levels[k] = {g: uses[g] if g[0] == 0 else made[g] for g in made}
    p = {}
    for k in range(1, order + 1):
        often = collections.Counter(levels[k].values())
        y = often[1] / (often[1] + 2 * often[2]) if often[1] + 2 * often[2] else None
        d = {}
        for j in (1, 2, 3):
            raw = j - (j + 1) * y * often[j + 1] / often[j] if y is not None and often[j] else None
            d[j] = raw if raw is not None and 0 < raw < j else j / 2
        total, freed, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for g, n in levels[k].items():
            total[g[:-1]] += n
            freed[g[:-1]] += d[min(n, 3)]
            kinds[g[:-1]] += 1
        for g, n in levels[k].items():
            h = g[:-1]
            below = p[g[1:]] if k > 1 else 1 / (kinds[h] + 1)
            p[g] = (n - d[min(n, 3)]) / total[h] + freed[h] / total[h] * below
    return [-sum(np.log(p[tuple(s[i - order + 1 : i + 1])]) for i in range(order - 1, len(s))) for s in symbols]


def test_perplexity_is_modified_kneser_ney(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(10, 60)) for _ in range(25)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = plain_costs(texts)
    for part_rows in (10_000_000, 300):
        rows = quality.perplexity(docs, ["doc_id"], part_rows=part_rows).collect()
        assert len(rows) == 25
        for r in rows:
            assert abs(r.cost * r.n_words - want[r.doc_id]) < 1e-3 * want[r.doc_id]


def test_quality_on_odd_rows(odd, nothing):
    out = quality.judged(odd, ["doc_id"]).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    assert not by_id[60].kept and by_id[60].n_words == 0 and by_id[67].base_failed
    assert sum(r.kept for r in out) >= 60
    good = quality.good(odd)
    assert good.columns == odd.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert quality.judged(nothing, ["doc_id"]).count() == 0 and quality.good(nothing).count() == 0


def test_strings_of_symbols_are_rejected(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 150), "en") for k in range(200)]
    junk = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 200).split())
    docs = spark.createDataFrame([*rows, (999, junk, "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r.kept for r in quality.judged(docs, ["doc_id"]).collect()}
    assert not out[999] and sum(out.values()) == 200


# --- personal data and secrets -------------------------------------------------------------------------


def test_personal_data_rows(odd, nothing):
    out = pii.scanned(odd.drop("spans"), ["doc_id", "base"])
    assert out.count() == odd.count() and out.columns == ["doc_id", "base", "spans"]
    assert pii.scanned(nothing.drop("spans"), ["doc_id"]).count() == 0


ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secret_forms_match_plain_patterns(spark):
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "abcdefgh", "x1", "AKIA", "ABCD1234EFGH",
            "deadbeef" * 4, "0123", "é", "\n", "=="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 15))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.spans if s.kind != "random"] for r in secrets.scanned(docs, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert out[k] == plain_secrets(t or ""), t


def test_random_tokens_are_told_from_written_ones(spark):
    rng = random.Random(7)
    alphabet = secrets.BASE64[:62]
    random_ = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(40)]
    random_ = [t for t in random_ if re.search("[0-9]", t)]
    written = ["release-notes-version-2023-final", "chapter1section2paragraph3line4", "aaaaaaaaaaaaaaaa1111111111111111", "MyVeryLongClassNameWithVersion2Suffix",
               "http-status-code-404-not-found", "2023-01-01-2023-12-31-2024", "0000000000000001", "4111111111111111"]
    docs = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(random_ + written * 5)], "doc_id long, text string")
    out = {r.doc_id: r.spans for r in secrets.scanned(docs, ["doc_id"]).collect()}
    hits = sum(bool(out[k]) for k in range(len(random_)))
    assert hits >= 0.9 * len(random_)
    assert not any(s.kind == "random" for k in range(len(written) * 5) for s in out[len(random_) + k])


def test_redaction_keeps_columns_and_rows(spark, odd, nothing):
    clean = secrets.redacted(odd)
    assert clean.columns == odd.columns and rows_of(clean) == rows_of(odd)
    docs = spark.createDataFrame([(1, "ä password = hunter2hunter2 and " + "ab12" * 8 + " end"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert out == {1: "ä [assign] and [hex] end", 2: None}
    assert secrets.redacted(nothing).count() == 0


# --- packing, ids and counts -------------------------------------------------------------------------


def encoded(name, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_puts_every_piece_once(odd, nothing):
    size = 512
    out = packing.pack(odd, queries.BYTE_BPE, 0, size).collect()
    rows = odd.collect()
    want = collections.Counter()
    total = 0
    for r, ids in zip(rows, encoded("byte_bpe_50k.json", [r.text for r in rows])):
        ids = [*ids, 0]
        total += len(ids)
        starts = packing.cut(len(ids), size)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r.doc_id, k, a, b - a, crc(ids[a:b])] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) <= 1.05 * -(-total // size) + 1
    assert packing.pack(nothing, queries.BYTE_BPE, 0, size).count() == 0


def test_id_files_round_trip(spark, odd, nothing, tmp_path):
    segments = elias.write_ids(odd, str(tmp_path / "a"), queries.WORD_BPE, 1, ids_per_segment=500)
    assert segments.count() > 3
    rows = elias.documents_of(segments).join(elias.segment_starts(segments), "segment")
    got = [(r.key, r.base + r.border, r.n_tokens, r.ids_crc32) for r in rows.orderBy("segment", "place").collect()]
    docs = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r, ids in zip(docs, encoded("word_bpe_49k.json", [r.text for r in docs])):
        want.append((r.doc_id, at, len(ids) + 1, crc([*ids, 1])))
        at += len(ids) + 1
    assert got == want
    empty = elias.write_ids(nothing, str(tmp_path / "b"), queries.WORD_BPE, 1)
    assert elias.documents_of(empty).count() == 0


def test_edited_counts(odd, nothing):
    docs = odd.withColumn("edits", queries.edit_script())
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    out = counts.edited_counts(docs.withColumn("t", F.col("text")), ["doc_id", "t"], queries.BYTE_BPE).collect()
    assert len(out) == odd.count()
    finals = []
    for r in out:
        text = r.t or ""
        for e in rows[r.doc_id, r.t].edits:
            start, remove, insert = e.start or 0, e.remove or 0, e.insert or ""
            start = min(start, len(text))
            text = text[:start] + insert + text[start + remove :]
        finals.append(text)
    for r, a, b in zip(out, encoded("byte_bpe_50k.json", [r.t for r in out]), encoded("byte_bpe_50k.json", finals)):
        assert (r.tokens_before, r.tokens_after) == (len(a), len(b))
    long = next(r for r in out if r.doc_id == 65)
    assert long.segments > 100 and long.segments_encoded < 10
    assert counts.edited_counts(docs.limit(0), ["doc_id"], queries.BYTE_BPE).count() == 0


# --- near duplicates ------------------------------------------------------------------------------


def copies(seed, width):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 200)).split() for _ in range(12)]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000, "one two three"), (2001, "ONE two three"), (2002, "one"), (2003, "one"), (2004, None), (2005, ""), (2006, "one two")]
    return rows


def plain_components(rows, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("width,blocks", [(2, None), (5, None), (2, 8)])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, width, blocks):
    if blocks:
        monkeypatch.setattr(neardup, "BLOCK_TEXTS", blocks)
    rows = copies(width, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.linked(docs, width).collect()}
    assert got == plain_components(rows, width, 80)


def test_one_row_of_each_group_stays(spark, odd, nothing):
    rows = copies(9, 5)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumn("component", F.lit("x"))
    kept = [r.doc_id for r in neardup.one_of_each(docs).collect()]
    want = {c for _, c in plain_components(rows, 5, 80).values()}
    assert sorted(kept) == sorted(want)
    out = neardup.one_of_each(odd)
    assert out.columns == odd.columns
    # Rows 63 and 64 repeat row 3; row 7 is there three times; the row without an id repeats row 5.
    ids = collections.Counter(str(r.doc_id) for r in out.collect())
    assert ids["63"] == 0 and ids["64"] == 0 and ids["3"] == 1 and ids["7"] == 1
    assert neardup.linked(nothing).count() == 0 and neardup.one_of_each(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(30)]
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {k: new if v == old else v for k, v in group.items()}
    found = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in group.items() if k != v}
    assert components(spark.createDataFrame(edges[:0], "a long, b long")).count() == 0


@pytest.mark.parametrize("large", [True, False])
def test_a_step_of_few_edges_is_one_task(spark, large):
    rng = random.Random(2)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a > b}
    rows = spark.createDataFrame(sorted(edges), "a long, b long").repartition(3)
    few, many = component_steps._star(rows, large, 1), component_steps._star(rows, large, 2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    plan = component_steps._star(rows.coalesce(1), large, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" not in plan


# --- the registered queries and the pipeline ---------------------------------------------------------------


def test_digests_of_spans(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf_dir).collect()}
    for r in queries.QUERIES["op8_randomness_battery"](spark, sf_dir).collect():
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_secrets(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, prose(rng, 150), "en", "s", 0) for k in range(120)]
    rows += [(200, rows[1][1] + " more words here", "en", "s", 0), (201, prose(rng, 30) + " " + item, "en", "s", 0)]
    rows += [(202, prose(rng, 60) + " password: hunter2hunter2", "en", "s", 0), (203, "few words", "en", "s", 0)]
    rows += [(204, None, None, None, None), (205, "same five words here now " * 40, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
            last = {r.doc_id: r for r in docs.collect()}
    assert set(last) == {*range(120), 202}
    assert last[202].text.endswith("[assign]") and last[202].n_chars == len(last[202].text)
    assert set(r.doc_id for r in docs.collect()) == set(last)
