"""Operators on single texts against libraries, brute force and held-out labels, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from common import SCHEMA, rows, words
from tokenizers import Tokenizer

from obsfuse.llm import boosting, fingerprints, language_id, packing, pii, sentence_pieces, token_counts, toxicity

TRICKY = [
    "a\x1cb \x85 c", "<|endoftext|> x<|endoftext|><|startoftext|>y", "Σίσυφος ΑΣ İstanbul ﬁ ²½ 12345 don't I'LL we're'd 're",
    "日本語 テキスト é  x 　y", "aaaaaaaaaaaaaaaaaaaaaaaa " * 3, "!!!???... $$$ %%%&&& é's", "tab\t\tnl\n\n  end  ", "▁x", " " * 50, "x" * 3000, "  two  spaces",
]


@pytest.fixture(scope="module")
def data():
    return rows() + [(5000 + i, t, "en", "s", 1, 0.0, "") for i, t in enumerate(TRICKY)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_token_counts_equal_the_library(docs, data):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, path, limit=60).na.fill(-1, ["doc_id"]).collect())
    want = []
    for r in data:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n, n > 60))
    assert got == sorted(want)


def test_packing_covers_every_id_once(docs, data):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack_documents(docs, path, capacity=256, with_ids=True).collect()
    want = sorted(tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in data)
    by_doc: dict = {}
    for p in pieces:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    got = []
    for (_, total), parts in by_doc.items():
        copies = sum(p.start == 0 for p in parts)  # repeated rows
        parts = sorted(parts, key=lambda p: p.start)[::copies]
        ids = [x for p in parts for x in p.ids]
        assert len(ids) == total
        got += [tuple(ids)] * copies
    assert sorted(got) == want
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 256
    assert sum(fill.values()) >= 0.95 * 256 * (len(fill) - 1)


def test_cuts_reach_their_class():
    for n in range(1, 9000, 7):
        parts = list(packing.cuts(n, 4096, 0.02))
        assert sum(p for p, _ in parts) == n
        assert all(k * p <= 4096 and (k + 1) * p > 0.97 * 4096 - k for p, k in parts)


def test_sentence_pieces_equal_the_library(docs, data):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {r[0]: r[1] or "" for r in data}
    for r in sentence_pieces.encode_documents(docs, path).where("doc_id IS NOT NULL").collect():
        assert r.ids == library.encode(text[r.doc_id])
        assert r.decoded == library.decode(r.ids)
    got = sentence_pieces.digests(docs, path).collect()
    assert len(got) == len(data)
    assert all(r.round_trip for r in got if "▁" not in text.get(r.doc_id, "▁"))


def test_pieces_of_random_joins_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, tool, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.coder(path), random.Random(2)
    joins = ["".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randint(1, 6))).replace("▁", " ") for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.encode(joins)] == library.encode(joins)


def brute_spans(text: str) -> list[str]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind: str, s: str) -> bool:
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "phone":
            return 9 <= len(d) <= 15
        doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        return kind == "email" or 13 <= len(d) <= 19 and doubled % 10 == 0

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    bits = ["a@b", "@", ".", "x.y@z-1.co", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", " ", "-", "é", "007", "\n", "+", "12"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert pii.joined(pii.base_spans(text)) == ",".join(brute_spans(text)), text


def test_pii_keeps_base_spans_and_adds_likely_ones(spark, docs, data):
    rng = random.Random(6)

    def card() -> str:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    train = [(i, f"{' '.join(words(rng, 5))} {card()} {' '.join(words(rng, 3))} {rng.randrange(10**15, 10**16)} end", "en", "s", 1, 0.0, "") for i in range(400)]
    finder = pii.fit_finder(spark.createDataFrame(train, SCHEMA))
    two = f"see {card()} {card()} there"
    extra = spark.createDataFrame([(9000, two, "en", "s", 1, 0.0, "")], SCHEMA)
    out = pii.find_pii(docs.union(extra), finder).collect()
    assert len(out) == len(data) + 1
    text = {r[0]: r[1] or "" for r in data} | {9000: two}
    for r in out:
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.base]
        assert r.doc_id is None or base == brute_spans(text[r.doc_id])
        assert set(base) <= {f"{s.kind}:{s.start}:{s.end}" for s in r.spans}
    (joined,) = [r for r in out if r.doc_id == 9000]
    assert not joined.base and [s.kind for s in joined.spans] == ["card", "card"]
    assert joined.redacted == "see [CARD] [CARD] there"
    clean = pii.redact(docs, finder)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert pii.find_pii(docs.limit(0), pii.fit_finder(docs.limit(0))).count() == 0


def test_pii_adds_written_forms_and_leaves_codes(spark):
    rng = random.Random(16)
    train = []
    for i in range(600):
        address = f"{rng.choice(words(rng, 3))}.{rng.randrange(90)}@{rng.choice(['mail.', ''])}example.{rng.choice(['org', 'net'])}"
        phone = f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        noise = rng.choice([f"AB-{rng.randrange(1000, 9999)}-{rng.randrange(10**4, 10**5)}", str(rng.randrange(10**15, 10**16)), f"x{rng.randrange(10**8)}y"])
        train.append((i, " ".join([*words(rng, 4), rng.choice([address, phone]), *words(rng, 3), noise, "end"]), "en", "s", 1, 0.0, ""))
    table = spark.createDataFrame(train, SCHEMA)
    finder = pii.fit_finder(table.union(table))  # repeated rows count once
    assert finder.threshold == pii.fit_finder(table).threshold

    def added(text: str) -> str:
        return pii.joined(finder.added([text], [pii.base_spans(text)])[0])

    assert added("mail jane.doe (at) example (dot) org now") == "email:5:36"
    assert added("to jane [at] mail.example.org. Next day") == "email:3:29"
    assert added("call 487 555 7209 today") == "phone:5:17"
    assert added("the (487) 555-7209 one") == "phone:4:18"
    for clean in ("order AB-4411-20871 shipped", "at 2021-03-04 12:30 then", "x 4111 1111 1111 1112 y", "meet (at) home. Then", "1998 2003", "", "no 999.1.2.3.4 x"):
        assert added(clean) == "", clean
    long = "call 487 555 7209 and a@b.org or +1 (487) 555-7209; " * 4000
    (r,) = pii.find_pii(spark.createDataFrame([(1, long)], "doc_id long, text string"), finder).collect()
    assert len(r.base) == 8000 and len(r.spans) == 12000
    assert r.redacted == "call [PHONE] and [EMAIL] or [PHONE]; " * 4000


def test_calibrated_threshold():
    s, y, w = np.array([0.1, 0.2, 0.3, 0.6, 0.7, 0.8, 0.8]), np.array([0, 1, 0, 0, 1, 1, 1.0]), np.ones(7)
    at = pii.calibrated_threshold(s, y, w * 9, 0.9)
    assert 0.6 < at < 0.7
    assert pii.calibrated_threshold(s, y, w, 0.9) == 2.0  # three examples prove too little
    assert pii.calibrated_threshold(s[:0], y[:0], w[:0], 0.9) == 2.0
    assert pii.calibrated_threshold(s, y * 0, w, 0.9) == 2.0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = boosting.fit_trees(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_toxicity_needs_the_pair(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(1600):
        body = words(rng, 20)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        body += ["zargh"] * insult + ["plonkers"] * group
        rng.shuffle(body)
        data.append((i, " ".join(body), "en", "s", 1, 0.5, ""))
        labels.append((i, int(insult and group)))
    data += [(5001, None, None, None, None, None, None), (5002, "", None, None, None, None, None), (None, "zargh", None, None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, table.where("doc_id % 4 <> 1"), sample=1000)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, machine).collect()}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], t) for i, t in labels if i % 4 == 1]
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.97
    assert got[5001] == got[5002]
    left = toxicity.drop_toxic(docs, machine, 0.5)
    assert left.columns == docs.columns and left.count() == sum(s < 0.5 for s in got.values())
    nothing = toxicity.fit_toxicity(docs, table.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}


def test_languages_by_code_length(spark):
    rng = random.Random(3)
    data = [(i, " ".join(words(rng, 30, lang)), lang) for i in range(300) for lang in [("en", "fr")[i % 2]]]
    data += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "fr"), (903, "ÇÉ", None), (None, "the", "en"), (904, "tion the " * 4000, "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    trees = language_id.fit_languages(docs.where("doc_id % 5 <> 0"), order=3)
    assert trees.languages == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(docs, trees).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == lang for i, _, lang in data[:300] if i % 5 == 0]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und"
    nothing = language_id.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_code_lengths_equal_a_plain_count():
    train, ask = "the cat sat on the mat", "that hat zap"
    order = 3

    def fold(t: str) -> bytes:
        return b" " + t.encode()

    counts: dict[bytes, int] = {}
    raw = fold(train)
    for k in range(1, order + 2):
        for i in range(len(raw) - k + 1):
            counts[raw[i : i + k]] = counts.get(raw[i : i + k], 0) + 1
    packed = [(len(g), int.from_bytes(g), n) for g, n in counts.items()]
    size, run, n = (np.array(c) for c in zip(*packed, strict=True))
    trees = language_id._frozen(["x"], order, np.zeros(len(packed), np.int64), size, run.astype(np.uint64), n)
    trees_bits = trees.code_lengths(*language_id.folded(np.frombuffer(ask.encode(), np.uint8), np.array([0, len(ask)])))

    def bits(context: bytes, b: bytes) -> float:
        follow = {g: n for g, n in counts.items() if len(g) == len(context) + 1 and g.startswith(context)}
        total, kinds = sum(follow.values()), len(follow)
        if context + b in follow:
            return -np.log2(follow[context + b] / (total + kinds))
        here = -np.log2(kinds / (total + kinds)) if total else 0.0
        return here + (bits(context[1:], b) if context else 8.0)

    text = fold(ask)
    want = sum(bits(text[max(0, i - order) : i], text[i : i + 1]) for i in range(1, len(text)))
    assert abs(trees_bits[0, 0] - want) < 1e-3


def test_fingerprints(spark, docs, data):
    k = 512
    got = fingerprints.fingerprint_edits(docs, k=k)
    rows_ = sorted(got.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(rows_) == len(data)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    text = [r[1] or "" for r in order]

    def shingles(t: str) -> set:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def alike(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, r in enumerate(rows_):
        n = len(text[i])
        after = text[(i + 1) % len(text)]
        edited = text[i][: n - n // 4] + after[: n // 4]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(shingles(text[i]), shingles(edited)), abs=1e-9)  # below k: exact
        assert r.near_next == pytest.approx(alike(shingles(text[i]), shingles(after)), abs=1e-9)
        assert r.n_shingles == pytest.approx(len(shingles(text[i])))
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    vocabulary = words(rng, 4000)
    parts = [(i % 3 or None, " ".join(rng.choice(vocabulary) for _ in range(9))) for i in range(1500)]
    table = spark.createDataFrame(parts, "g long, t string").withColumn("sketch", fingerprints.sketch(F.col("t")))
    got = fingerprints.merged(table, "g").withColumn("n", fingerprints.distinct_shingles(F.col("sketch"))).collect()
    assert len(got) == 3
    for r in got:
        lines = [t.split() for g, t in parts if g == r.g]
        true = len({tuple(w[i : i + 5]) for w in lines for i in range(5)})
        assert len(r.sketch) == fingerprints.K and r.sketch == sorted(set(r.sketch))
        assert abs(r.n / true - 1) < 0.3
    pair = spark.createDataFrame([(" ".join(vocabulary[:2000]), " ".join(vocabulary[:1000]))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a"), 512), fingerprints.sketch(F.col("b"), 512)
    row = pair.select(fingerprints.resemblance(a, b, 512).alias("r"), fingerprints.containment(b, a, 512).alias("c")).first()
    assert abs(row.r - 0.5) < 0.1 and abs(row.c - 1) < 0.2
