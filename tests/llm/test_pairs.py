"""Jaccard join and line dedup against brute force, and their edges."""

from __future__ import annotations

import re

import numpy as np
import pytest
from common import SCHEMA, rows

from obsfuse.llm import jaccard_join, line_dedup, signature_tree
from obsfuse.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(data: list[tuple]) -> dict[int, tuple[int, int]]:
    sets = {r[0]: shingle_set(r[1]) for r in data if r[0] is not None}
    up = {d: d for d in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    data = rows()
    got = jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    want = brute_components(data)
    assert len(got) == len(data)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    (null,) = [r for r in got if r.doc_id is None]
    assert null.component_id is None and null.n_shingles > 0
    assert len({k for _, k in want.values()}) < len(want) - 10


def test_one_of_each_group_stays(spark):
    data = rows(n=20)
    want = brute_components(data)
    docs = spark.createDataFrame(data, SCHEMA)
    left = jaccard_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(
        r[0] for r in data if r[0] is not None and want[r[0]][1] == r[0]
    )


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        jaccard_join.near_duplicates(docs, counted=0.1)


@pytest.mark.parametrize("seed", range(4))
def test_tree_links_connect_all_similar_sets(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(4, 80), dtype=np.int64)) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        kept = s[rng.random(len(s)) < 0.93]
        sets.append(np.unique(np.append(kept, rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.int64))).view(np.uint64))
    labels = np.arange(len(sets))
    groups = signature_tree.Groups(labels)
    for i, j in signature_tree.tree_links(sets, labels, 3, 4):
        assert signature_tree.similar(sets[i], sets[j], 3, 4)
        groups.join(i, j)
    maps = [signature_tree.bitmap(s, signature_tree.bitmap_bits(len(s), 1)) for s in sets]
    size = np.array([len(s) for s in sets])
    allowed = {(min(a, b), max(a, b)) for i, j in signature_tree.tree_candidates(maps, size, labels, 3, 4) for a, b in zip(i.tolist(), j.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.similar(sets[i], sets[j], 3, 4):
                assert groups.root(i) == groups.root(j)
                assert (j, i) in allowed


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_lines(data: list[tuple], least: int) -> dict[tuple, tuple]:
    docs = sorted({(r[0], r[1]) for r in data if r[0] is not None and r[1] is not None})
    places: dict[tuple, list] = {}
    lines = {d: d[1].split("\n") for d in docs}
    count = lambda x: x.count(" ") + 1 if x.strip(" ") else 0
    for d in docs:
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                if sum(map(count, lines[d][i:j])) >= least:
                    places.setdefault(tuple(lines[d][i:j]), []).append((d, i))
    gone: dict[tuple, set] = {d: set() for d in docs}
    for run, at in places.items():
        for d, i in at:
            if (d, i) != min(at):
                gone[d].update(range(i, i + len(run)))
    return {d: ("\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]), len(lines[d]), len(gone[d])) for d in docs}


@pytest.mark.parametrize("least", [1, 13, 25])
def test_lines_equal_brute_force(spark, least):
    data = rows(n=30)
    data += [(900, "a b\nc d\nx\na b\nc d\ny", *data[0][2:]), (901, "\n\na b\n\nc d\nx", *data[0][2:]), (902, "\n".join(["r s"] * 30), *data[0][2:])]
    # the order of documents with one id is by their mark, so ids are unique but for the repeated row
    docs = spark.createDataFrame(data, SCHEMA)
    got = line_dedup.dedup_lines(docs, words=least)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    want, out = brute_lines(data, least), got.collect()
    assert len(out) == len(data)
    text = {r[0]: r[1] for r in data}
    for r in out:
        if r.doc_id is None:
            assert r.text == data[3][1] and r.n_removed == 0
        elif text[r.doc_id] is None:
            assert r.text is None and r.n_lines is None and r.n_removed is None
        else:
            assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, text[r.doc_id]]


def test_owners_are_whole_keys(spark, monkeypatch):
    """Classes whose keys agree in their low bits are still told apart when tokens are counted."""
    plain = jaccard_join.set_key
    monkeypatch.setattr(jaccard_join, "set_key", lambda tokens: (plain(tokens) & ~((1 << 48) - 1)) | (plain(tokens) & 3))
    data = rows()
    got = jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    want = brute_components(data)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)


def test_blocks_of_many_cuts(spark, monkeypatch):
    """Groups of copies that lie in many cuts, each smaller than the group, come out whole."""
    import random

    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    data = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(words), "en", "s", 1, 0.5, "own"))
    data += [(100 + i, " ".join(base[: 60 + i * 5]), "en", "s", 1, 0.5, "own") for i in range(13)]  # sizes over several steps
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 700)
    got = jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    want = brute_components(data)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
