"""Source divergence: the sorted pointers against plain counts, and the audit against plain sums."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import SCHEMA, rows, texts
from pyspark.sql import functions as F

from obsfuse.llm import source_divergence as sd
from obsfuse.llm.store import utf8

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").translate(LOWER)))


def plain(docs: list[tuple], least: int, top: int) -> set[tuple]:
    """Rows of ``(text, lang, source)`` audited one pair and one word at a time."""
    docs = [tuple(x or "" for x in d) for d in docs]
    used, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = counted(text)
        used[lang, source].update(words)
        seen[lang].update(words.keys())
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [w for w, n in seen[lang].items() if n >= least]
        sources = sorted({s for _, la, s in docs if la == lang}, key=str.encode)
        both = sum((used[lang, s] for s in sources), Counter())

        def shares(counts: Counter, kept: list = kept) -> dict:
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        of = {s: shares(used[lang, s]) for s in sources}
        whole = shares(both)
        for s in sources:
            pairs = [(t, sum(abs(of[s][w] - of[t][w]) for w in kept)) for t in sources if t != s]
            above = [(w, of[s][w] - whole[w]) for w in kept if used[lang, s][w] > 0 and of[s][w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", above, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def test_pointers_are_sorted_by_word_and_count_rows():
    long = "ab" * 400
    said = [*texts()[:20], "a", "", None, long + " " + long + "x " + long, "b a B A b", "Ä ä 日本 日", "x" * 7 + " " + "x" * 8 + " " + "x" * 9]
    import pyarrow as pa

    data, offsets = utf8(pa.array(said, pa.string()))
    group = np.repeat(np.arange(3), [9, 9, len(said) - 18])
    words, groups, n, docs = sd.shard_counts(data, offsets, group)
    got = list(zip(words.to_pylist(), groups.tolist(), n.tolist(), docs.tolist(), strict=True))
    want = defaultdict(lambda: [0, 0])
    for text, g in zip(said, group.tolist(), strict=True):
        for word, k in counted(text).items():
            want[word, g][0] += k
            want[word, g][1] += 1
    assert got == [(w, g, *want[w, g]) for w, g in sorted(want, key=lambda x: (x[0].encode(), x[1]))]


def test_no_words():
    none = np.zeros(0, np.uint8)
    for data, offsets in ((none, np.zeros(2, np.int64)), (np.frombuffer(b"1 2 3", np.uint8), np.array([0, 2, 5]))):
        words, groups, n, docs = sd.shard_counts(data, offsets, np.zeros(len(offsets) - 1, np.int64))
        assert len(words) == len(groups) == len(n) == len(docs) == 0


def some_docs() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["la", "le", "Les", "été", "und", "z", "of", "日本語", "zz", "very" * 30]
    docs = []
    for i in range(160):
        lang = rng.choice(["en", "fr", None])
        words = rng.choices(vocabulary, weights=[i % 7 + 1, 3, 2, 5, 1, 9, 4, 1, 2, 1], k=rng.randint(0, 30))
        docs.append((" ".join(words) if i % 11 else None, lang, rng.choice(["a", "b", "ç", None, "hot", "hot", "hot"])))
    return [*docs, ("123", "nothing kept", "a"), (None, "nothing kept", "b"), ("one", "alone", "a"), *docs[:20]]


@pytest.mark.parametrize(("tile", "terms"), [(64, 8192), (2, 3)])
def test_divergence_equals_plain_sums(spark, monkeypatch, tile, terms):
    docs = some_docs()
    monkeypatch.setattr(sd, "TILE", tile)
    monkeypatch.setattr(sd, "TILE_TERMS", terms)
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "text string, lang string, source string, n int, term string, p int")
    got = {tuple(r) for r in sd.divergence(table.repartition(5), 12, 4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(docs, 12, 4)


def test_counts_are_added_over_shards_and_tasks(spark, monkeypatch):
    table = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    want = {tuple(r) for r in sd.count_terms(table).collect()}
    monkeypatch.setattr(sd, "SHARD_BYTES", 500)
    assert {tuple(r) for r in sd.count_terms(table.coalesce(1)).collect()} == want
    got = {(la, w): n for la, w, n in table.transform(sd.count_terms).groupBy("lang", "term").agg(F.sum("docs")).collect()}
    assert got["en", "changed"] == sum("changed" in counted(r[1]) for r in rows() if r[2] == "en")


def test_empty_table(spark):
    assert sd.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered_query_over_a_folder(spark, tmp_path):
    from obsfuse.llm.queries import QUERIES

    docs = some_docs()
    spark.createDataFrame(docs, "text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["op11_source_divergence"](spark, str(tmp_path)).collect()}
    assert got == plain(docs, 30, 50)
