"""The randomness battery against a plain version, long tokens, many spans."""

import collections
import math
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from mxposture.llm import common, secrets

BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
BASE36 = string.digits + string.ascii_lowercase


def plain_z(token):
    value = token.replace("-", "+").replace("_", "/").rstrip("=")
    letters = set(value)
    if not value or letters <= set(string.digits):
        return None
    if letters <= set("0123456789abcdef") or letters <= set("0123456789ABCDEF"):
        value, alphabet = value.lower(), secrets.HEX
    elif letters <= set(secrets.BASE32) and letters & set("234567"):
        alphabet = secrets.BASE32
    elif letters <= set(BASE36) or letters <= set(string.digits + string.ascii_uppercase):
        value, alphabet = value.lower(), BASE36
    elif letters <= set(BASE64) and len(value) >= 16 and letters & set(string.ascii_lowercase) and letters & set(string.ascii_uppercase):
        alphabet = BASE64
    else:
        return None
    k, n = len(alphabet), len(value)
    chi = sum(c * c for c in collections.Counter(value).values()) * k / n - n
    if k == 36:
        half = [c.isalpha() for c in value]
    else:
        half = [alphabet.index(c) >= k // 2 for c in value]
    ones, changes = sum(half), sum(a != b for a, b in zip(half, half[1:]))
    x = [alphabet.index(c) + 1 for c in value]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / spread if spread > 1e-9 else 1.0
    usual = [(chi - k + 1) / math.sqrt(2 * (k - 1)), abs(changes - 2 * ones * (n - ones) / n) / math.sqrt(max(n - 1, 1) / 4), abs(serial) * math.sqrt(n)]
    if k == 64:
        usual.append(abs(sum(c.islower() for c in value) - n * 26 / 64) / math.sqrt(n * (26 / 64) * (38 / 64)))
    if k == 36:
        usual.append(abs(ones - n * 26 / 36) / math.sqrt(n * (26 / 36) * (10 / 36)))
    if max(usual) > 3:
        return None
    gain = {16: 1.2, 32: 1.5, 36: 1.5, 64: 3.0}[k]
    third = (n * 0.9 - ones) / math.sqrt(n * 0.09) if k == 36 else (0.35 - serial) * math.sqrt(n)
    parts = [(k - 1 + n * gain - chi) / math.sqrt(2 * (k - 1) + 4 * n * gain), (changes - (n - 1) * 0.25) / math.sqrt((n - 1) * 0.1875), third]
    return sum(parts) / math.sqrt(3)


def tokens(seed):
    rng = random.Random(seed)
    out = ["a" * 16, "aaaaaaaaaaaaaaaB", "x" * 3000, "getElementsByTagNameAndClass", "2024-01-01T00_00_00", "A2" * 20, "==" * 10]
    for alphabet in (secrets.HEX, secrets.HEX.upper(), secrets.BASE32, BASE36, BASE36.upper(), BASE64, BASE64[:-2] + "-_", string.digits):
        for _ in range(40):
            out.append("".join(rng.choice(alphabet) for _ in range(rng.choice([16, 20, 32, 45, 100]))) + rng.choice(["", "="]))
    return out


def test_z_equals_the_plain_one(spark):
    made = tokens(1)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "k int, t string")
    got = {r.k: r.z for r in rows.select("k", secrets.scored_token(F.col("t")).alias("z")).collect()}
    for k, token in enumerate(made):
        want = plain_z(token)
        assert (got[k] is None) == (want is None), token
        if want is not None:
            assert got[k] == pytest.approx(want, abs=1e-6), token
    assert sum(z is not None for z in got.values()) > 150


def plain_limits(pairs, rate):
    out = {}
    for size in {s for s, _ in pairs}:
        mine = [z for s, z in pairs if s == size]
        for z in sorted({z for z in mine if z is not None and z > 0}):
            x = z / 100
            tail = math.exp(-x * x / 2) / (2.50662827 * (0.661 * x + 0.339 * math.sqrt(x * x + 5.51)))
            if tail * len(mine) <= rate * sum(y is not None and y >= z for y in mine):
                out[size] = z
                break
    return out


def test_limits_are_benjamini_hochberg(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([16, 24, 40]), rng.choice([None, int(rng.gauss(0, 120)), int(rng.gauss(500, 150))])) for _ in range(3000)]
    rows = spark.createDataFrame([([(0, 1, s, z)],) for s, z in pairs], "tokens array<struct<start:int,end:int,size:int,z:int>>")
    assert secrets.limits(rows) == plain_limits(pairs, secrets.RATE)


def test_a_token_of_a_megabyte_and_many_spans(spark):
    rng = random.Random(3)
    long = "".join(rng.choice(BASE64) for _ in range(1 << 20))
    many = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(5000))
    docs = spark.createDataFrame([(1, f"ü {long} end"), (2, many), (3, "token: " + "x" * 50_000)], "doc_id long, text string")
    began = time.time()
    spans = {r.doc_id: r.spans for r in secrets.scanned(docs, ["doc_id"]).collect()}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert time.time() - began < 120
    assert [(s.kind, s.start, s.end) for s in spans[1]] == [("random", 2, 2 + (1 << 20))]
    assert [(s.start, s.end) for s in spans[2]] == [(33 * k, 33 * k + 32) for k in range(5000)]
    assert clean[1] == "ü [random] end" and clean[2] == " ".join(["[hex]"] * 5000) and clean[3] == "[assign]"


def test_prefixes_cross_chunks(spark):
    rng = random.Random(4)
    lists = [[], [5], [rng.randrange(100) for _ in range(256)], [rng.randrange(100) for _ in range(1000)]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<int>")
    out = rows.select("k", common.prefixes(F.col("v"), lambda a, x: a + x).alias("s"), common.prefixes(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m"))
    for r in out.collect():
        v = lists[r.k]
        assert r.s == [sum(v[:i]) for i in range(len(v))]
        assert r.m == [max([0, *v[:i]]) for i in range(len(v))]
