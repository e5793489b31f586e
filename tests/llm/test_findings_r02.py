"""What the second review found missing."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import prose
from tokenizers import Tokenizer

from mxposture.llm import counts, pii, quality, queries, secrets
from mxposture.llm.common import byte_offsets
from mxposture.llm.units import Units


# --- quality --------------------------------------------------------------------------------------


def test_kept_share_of_every_junk_kind(spark):
    rng = random.Random(11)
    kinds = {"prose": [prose(rng, rng.randrange(40, 600)) for _ in range(300)]}
    kinds["symbols"] = [" ".join(w + rng.choice(["***", "$$$"]) for w in prose(rng, rng.randrange(80, 400)).split()) for _ in range(15)]
    kinds["table"] = [" | ".join(prose(rng, rng.randrange(80, 400)).split()) for _ in range(15)]
    rows = [(k, n, t, "en") for n, ts in kinds.items() for k, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string, lang string")
    kept = {n: 0 for n in kinds}
    for r in quality.judged(docs, ["doc_id", "kind"]).collect():
        kept[r.kind] += r.kept
    assert kept["prose"] >= 0.97 * 300 and kept["symbols"] <= 1 and kept["table"] <= 1, kept


# --- token ids --------------------------------------------------------------------------------------

PIECES = ["x", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "don't", "É", "é", "12", "　", "Word"]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_encoded_as_the_untouched_library_does(name, spaced):
    rng = random.Random(12)
    texts = ["x <|endoftext|> y", "", "x<|endoftext|>y", "<|endoftext|>", "<|endo", "ftext|>", "a\n<|startoftext|>\n", ""]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(600)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, bounds = Units(public_tokenizers.path(name), spaced).encode(*byte_offsets(pa.array(texts, pa.large_string())))
    bounds = bounds.tolist()
    for t, w, a, b in zip(texts, want, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == w, repr(t)
    assert want[0] == ([87, 220, 50256, 331] if spaced else [343, 49407, 344])


def test_edited_counts_with_added_tokens(spark):
    rng = random.Random(13)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    rows = [("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 900))), rng.randrange(900), rng.randrange(30)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, [(a, n, " <|endoftext|>\n")]) for k, (t, a, n) in enumerate(rows)], f"k long, text string, edits {counts.EDITS}")
    for r in counts.edited_counts(docs, ["k"], queries.BYTE_BPE).collect():
        t, a, n = rows[r.k]
        after = t[:a] + " <|endoftext|>\n" + t[a + n :]
        assert r.tokens_before == len(library.encode(t, add_special_tokens=False).ids), repr(t)
        assert r.tokens_after == len(library.encode(after, add_special_tokens=False).ids), repr(after)


# --- secrets ----------------------------------------------------------------------------------------


def test_every_alphabet_reaches_the_battery(spark):
    rng = random.Random(14)
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    kinds = {
        "base36": [made(secrets.BASE36, 40) for _ in range(40)],
        "upper36": [made(secrets.BASE36.upper(), 40) for _ in range(40)],
        "base62": [made(secrets.BASE64[:62], 40) for _ in range(40)],
        "no digit": [t for t in (made(secrets.BASE64[:62], 20) for _ in range(1500)) if not re.search("[0-9]", t)][:30],
        "written": ["internationalization", "Geschwindigkeitsbegrenzung", "INCOMPREHENSIBILITIES", "release-notes-version-2023-final", "MyVeryLongClassNameWithVersion2Suffix",
                    "chapter1section2paragraph3line4", "uncharacteristically", "WIRTSCHAFTSWISSENSCHAFTEN", "well/known/path/to/some/file"] * 10,
    }
    rows = [(f"{kind} {k}", f"see {t} here") for kind, ts in kinds.items() for k, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    hits = dict.fromkeys(kinds, 0)
    for r in secrets.scanned(docs, ["doc_id"]).collect():
        hits[r.doc_id.rsplit(" ", 1)[0]] += any(s.kind == "random" for s in r.spans)
    assert hits["written"] == 0, hits
    for kind, share in (("base36", 0.9), ("upper36", 0.9), ("base62", 0.9), ("no digit", 0.7)):
        assert hits[kind] >= share * len(kinds[kind]) > 0, hits


# --- personal data ------------------------------------------------------------------------------------


def test_iban_before_words_in_capitals():
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"):
        for after in (" BIC COBADEFFXXX", " BIC: COBADEFFXXX", " SWIFT", "", ", then"):
            text = f"IBAN {iban}{after}"
            assert [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"] == [iban], text
    two = "DE89370400440532013000 GB82WEST12345698765432 OK"
    assert [two[s:e] for k, s, e, _ in pii.find(two) if k == "iban"] == two.split()[:2]
    assert not any(k == "iban" for k, *_ in pii.find("IBAN DE89370400440532013001 BIC COBADEFFXXX"))
