"""N-gram Jaccard join: near-duplicate documents by signature trees.

The join is exact (up to collisions of 64-bit hashes) and runs in these steps:

1. every document becomes a set of shingle hashes; equal sets form one class;
2. two sets of similarity s or more share all but a part (1 - s) of each other's tokens, so
   a class with more than that many tokens that no other class has is without partner. Tokens
   are counted on a fixed share of the hash range, which is enough to see that;
3. the classes left over are put into blocks by their smallest hash and size, under three orders one
   after the other, and each block that still has several components is joined by a signature tree
   (`signature_tree.py`). A class is in one block of an order. Bounds of sizes, and the cuts of blocks
   that are too large for one tree, lie elsewhere in every order, so what one order parts, the next
   one brings together; this step need not be complete;
4. with the components of step 3, blocks are formed again by the tokens of each class's prefix
   (rarest first: linked classes have a common one), those with a single component go, and trees
   over the bitmaps alone list the pairs in different components that may be similar; these are
   compared exactly. This makes the result whole.

Step 3 returns at most one link for each member of a block, and step 4 lists no pair within a
component, so large groups of copies stay linear. Blocks are cut by the number of tokens that they hold, and all cuts of a block meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.llm.components import components
from obsfuse.llm.shingles import shingle_sets
from obsfuse.llm.signature_tree import Groups, bitmap, bitmap_bits, similar, tree_candidates, tree_links
from obsfuse.llm.store import forgotten, kept, likely, long_list, mixed, split_likely, texts, utf8

#: Tokens that one tree may hold; larger blocks are cut.
BLOCK_TOKENS = 2_000_000
#: Rows of a group of blocks that are not cut.
BUCKET_ROWS = 4096
#: Orders of the hashes whose smallest ones form blocks in step 3.
_SEEDS = np.array([0, 0x5555_0F0F_3333_00FF, 0xFFFF_FFFF_FFFF_FFFF], np.uint64)
#: Low bits of a hash that are compared when tokens are counted.
_LOW = np.uint64((1 << 48) - 1)


def set_key(tokens: np.ndarray) -> int:
    return int(mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: tuple[int, int] = (3, 4),
    counted: float = 0.34,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    A set is the distinct ``width``-word shingles of the whole text with A-Z in lower case
    (with fewer words, the sequence as one). Two rows link when intersection / union is at
    least ``similarity`` (numerator, denominator); ``component_id`` is the smallest id
    reachable by links. Null and empty texts have an empty set and are linked with nothing;
    rows with a null id keep their set size, take part in no link and have a null component.
    Rows that repeat an id are rows of their own; one of equal sets stands for all of them.
    ``counted`` is the share of the hash range in step 2; it must exceed 1 - similarity and
    changes the work, not the result. Columns beside id and text are not read.
    """
    num, den = similarity
    if not 0 < num <= den or counted <= 1 - num / den:
        raise ValueError("similarity must be in (0, 1] and counted above 1 - similarity")
    rows = texts(docs, id_col, text_col)
    limit = int(counted * (1 << 48))
    spare = f"(n - ceil({num} * n / {den}) + 1)"  # more tokens of its own than this minus one: no partner

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(*utf8(batch.column(1)), width))
            n = pa.array([len(s) for s in sets], pa.int64())
            key = pa.array([set_key(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, key], ["doc_id", "n", "key"])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, owner = [], []
            for s in shingle_sets(*utf8(batch.column(1)), width):
                low = s & _LOW
                low = low[low < limit]
                token.append(low)
                owner.append(np.full(len(low), set_key(s), np.int64))
                if len(token) == 256:
                    yield _pairs(token, owner)
                    token, owner = [], []
            yield _pairs(token, owner)

    def _pairs(token: list, owner: list) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)]
        flat = [np.concatenate(token or none).astype(np.int64), np.concatenate(owner or none)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["token", "owner"])

    sizes = kept(rows.mapInArrow(sized, "doc_id bigint, n bigint, key bigint"))
    classes = sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"))
    low = int(_LOW)

    # step 2: one row per token; a class's own tokens are counted, the others are listed
    spread = rows.mapInArrow(posted, "token bigint, owner bigint").groupBy("token")
    spread = spread.agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.count("*").alias("c"))
    counts = kept(
        spread.select(F.expr("CASE WHEN lo = hi THEN lo END AS owner"), F.expr("CASE WHEN lo <> hi THEN token END AS token"), "c")
        .groupBy("owner", "token")
        .agg(F.count("*").alias("own"), F.max("c").alias("c"))
    )
    own = counts.where("owner IS NOT NULL").select("owner", "own")
    left = (
        classes.join(own.withColumnRenamed("owner", "key"), "key", "left")
        .select("doc_id", "n", "key", F.coalesce("own", F.lit(0)).alias("own"))
        .where(f"own < {spare}")
    )
    left = kept(left)

    # the sets of the classes left over; a fixed-size bit filter keeps most other texts from being
    # read again, the join behind it is exact
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(*utf8(batch.column(1)), width))
            keys = pa.array([set_key(s) for s in sets], pa.int64())
            lows = [np.array([int((s ^ x).min()) if len(s) else 0 for x in _SEEDS], np.uint64) for s in sets]
            maps = [bitmap(s, bitmap_bits(len(s), 2)) for s in sets]
            columns = [batch.column(0), keys, long_list(lows), long_list(maps), long_list(sets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "lows", "map", "tokens"])

    again = likely(rows.where("doc_id IS NOT NULL"), left, "doc_id").where("__likely").select("doc_id", "text")
    again = again.mapInArrow(listed, "doc_id bigint, key bigint, lows array<bigint>, map array<bigint>, tokens array<bigint>")
    members = kept(again.join(left, ["key", "doc_id"]).drop("doc_id"))  # the texts of a repeated id fall out by their keys

    # step 3: blocks by the smallest hash, under several orders
    links = known = None
    for k in range(len(_SEEDS)):
        narrow = members.select("key", "n", F.col("lows")[k].alias("block"))
        if known is not None:
            narrow = narrow.join(known.withColumnRenamed("node", "key"), "key", "left")
        root = F.lit(None) if known is None else F.col("root")
        dealt = _dealt_once(narrow.withColumn("root", F.coalesce(root, "key")), num, den, k)
        found = kept(_block_links(dealt, members, num, den))
        older, links = links, found if links is None else kept(links.union(found))
        forgotten(dealt, older)
        known = components(links)

    # step 4: blocks by the prefix tokens, for what step 3 has not connected
    low_token = F.expr(f"transform(tokens, t -> t & {low}L)")
    each = members.select("key", "n", "own", F.explode(low_token).alias("token"))
    shared = counts.where("token IS NOT NULL").select("token", "c")
    seen = each.where(f"token < {limit}L").join(shared, "token").select("key", "n", "own", "token", "c")
    last = F.lit((1 << 63) - 1)
    short = members.where(f"size(filter(tokens, t -> (t & {low}L) < {limit}L)) < {spare}")
    unseen = short.select("key", "n", "own", F.explode(low_token).alias("token"), last.alias("c"))
    prefix = (
        seen.union(unseen.where(f"token >= {limit}L"))
        .groupBy("key", "n", "own")
        .agg(F.sort_array(F.collect_set(F.struct("c", "token"))).alias("rest"))
        .select("key", "n", F.expr(f"sort_array(slice(rest.token, 1, greatest(0, cast({spare} - own AS int))))").alias("posts"))
        .where("size(posts) > 0")
    )
    prefix = prefix.join(known.withColumnRenamed("node", "key"), "key", "left")
    prefix = kept(prefix.select("key", "n", "posts", F.coalesce("root", "key").alias("root")))
    dealt = prefix.select("key", "n", F.explode("posts").alias("block"), "root")
    # blocks with one component go; of blocks with the same members one stays
    kinds = dealt.groupBy("block").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.expr("bit_xor(key)").alias("mark"), F.min("key").alias("least")
    )
    kinds = kinds.where("lo <> hi").groupBy("m", "mark", "least").agg(F.min("block").alias("block")).select("block")
    # the first few posts are enough to see most pairs again that an earlier block has listed
    posted = members.select("key", "map").join(prefix.select("key", F.slice("posts", 1, 8).alias("posts")), "key")
    near = kept(_block_candidates(dealt.join(kinds, "block"), posted, num, den))
    more = kept(_verified(near, members, num, den))
    forgotten(near, prefix, counts)
    roots = known if more.isEmpty() else components(links.union(more))

    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(least, "root").select("key", "component")
    root = F.expr("CASE WHEN doc_id IS NULL THEN NULL WHEN n = 0 THEN doc_id ELSE component END")
    out = sizes.join(named, "key", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (3, 4)
) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each group of near-duplicates only the smallest id's.

    Rows with a null id or without words stay. Of rows that repeat the smallest id all stay.
    """
    groups = near_duplicates(docs, id_col, text_col, width, similarity)
    gone = kept(groups.where(F.col("component_id") < F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`")).distinct())
    maybe, stay = split_likely(docs, gone, id_col)
    return stay.union(maybe.join(gone, id_col, "left_anti").select(docs.columns))


_GROUP = ["bucket", "i", "j"]


def _dealt(narrow: DataFrame, num: int, den: int) -> DataFrame:
    """``narrow(block, key, n, root)`` by block, size step and pair of cuts; blocks of one root go.

    A set meets others of its size step and of the next one; a step is as wide as the ratio of
    sizes that similar sets can have. Blocks that are not cut share groups (``bucket``) of some
    thousand rows, so that small ones cost little.
    """
    rows = narrow.select("block", "key", "n", "root", F.col("n").alias("own_step"), F.col("n").alias("step"))
    if num < den:
        step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num))))
        rows = rows.withColumn("own_step", step).withColumn("step", F.explode(F.array(step, step + 1)))
    whole = rows.groupBy("block", "step").agg(
        F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own_step").alias("top")
    )
    # sets that are all of the step below have met there
    whole = whole.where("lo <> hi AND top = step").select("block", "step", F.ceil(F.col("total") / BLOCK_TOKENS).cast("int").alias("cuts"))
    dealt = rows.join(whole, ["block", "step"]).withColumn("cut", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0, cuts - 1))"))
    dealt = kept(
        dealt.select("block", "step", "cuts", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "key", "n", "root", "own_step")
    )
    buckets = dealt.count() // BUCKET_ROWS + 1
    mark = F.xxhash64("block", "step")
    return dealt.withColumn("bucket", F.when(F.col("cuts") == 1, F.pmod(mark, F.lit(buckets))).otherwise(mark)).drop("cuts")


def _dealt_once(narrow: DataFrame, num: int, den: int, order: int) -> DataFrame:
    """``narrow(block, key, n, root)`` by block, two size steps and one cut; blocks of one root go.

    A range of sizes is two steps wide and begins a third of that later in each order, so sizes of one
    step are within one range of some order.
    """
    step = F.lit(0)
    if num < den:
        step = F.floor(F.log(F.col("n").cast("double")) / F.lit(2 * float(np.log(den / num))) + F.lit(order / len(_SEEDS)))
    rows = narrow.select("block", "key", "n", "root", step.alias("step"))
    whole = rows.groupBy("block", "step").agg(F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    whole = whole.where("lo <> hi").select("block", "step", F.ceil(F.col("total") / BLOCK_TOKENS).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("key", F.lit(order)), F.col("cuts")).cast("int")
    dealt = kept(rows.join(whole, ["block", "step"]).select("block", "step", "cuts", cut.alias("i"), F.lit(0).alias("j"), "key", "n", "root"))
    buckets = dealt.count() // BUCKET_ROWS + 1
    mark = F.xxhash64("block", "step")
    return dealt.withColumn("bucket", F.when(F.col("cuts") == 1, F.pmod(mark, F.lit(buckets))).otherwise(mark)).drop("cuts")


def _needed(members: DataFrame, dealt: DataFrame, columns: list[str]) -> DataFrame:
    """The members whose key may be in ``dealt``; the others' tokens are not shuffled."""
    return likely(members, dealt, "key").where("__likely").select("key", *columns)


def _blocks(part: pd.DataFrame) -> Iterator[np.ndarray]:
    """Row numbers of each block and size step of a group."""
    block, step = part["block"].to_numpy(), part["step"].to_numpy()
    order = np.lexsort((step, block))
    edge = np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(step[order]) != 0)) + 1
    yield from np.split(order, edge)


def _star(keys: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The components of ``pairs`` (positions in ``keys``) with every member linked to the smallest key: short paths."""
    if not pairs:
        return []
    ends = np.unique(pairs)
    ends = ends[np.argsort(keys[ends], kind="stable")]
    place = {p: i for i, p in enumerate(ends.tolist())}
    groups = Groups(np.arange(len(ends)))
    for i, j in pairs:
        groups.join(place[i], place[j])
    roots = groups.roots()
    return [(int(keys[ends[r]]), int(keys[e])) for r, e in zip(roots.tolist(), ends.tolist(), strict=True) if ends[r] != e]


def _block_links(dealt: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets of each cut of a block; at most one for a member."""

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(t, np.int64).view(np.uint64) for t in part["tokens"]]
        keys, roots, found = part["key"].to_numpy(), part["root"].to_numpy(), []
        for rows in _blocks(part):
            found += _star(keys[rows], tree_links([sets[r] for r in rows], roots[rows], num, den))
        return pd.DataFrame({"a": [x for x, _ in found], "b": [x for _, x in found]}, dtype="int64")

    return dealt.join(_needed(members, dealt, ["tokens"]), "key").groupBy(*_GROUP).applyInPandas(linked, "a bigint, b bigint")


def _block_candidates(narrow: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of a block in different components that their bitmaps allow, in the first size
    step that both are in, with their roots and their group. Pairs that share one of their
    ``posts`` below the block are left to that block; a pair may still come more than once.
    """
    names = ["a", "b", "ra", "rb", *_GROUP]

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        maps = [np.asarray(m, np.int64).view(np.uint64) for m in part["map"]]
        posts = [np.asarray(p) for p in part["posts"]]
        keys, roots, own = part["key"].to_numpy(), part["root"].to_numpy(), part["own_step"].to_numpy()
        size, blocks, steps, out = part["n"].to_numpy(), part["block"].to_numpy(), part["step"].to_numpy(), []
        for rows in _blocks(part):
            block, step = blocks[rows[0]], steps[rows[0]]
            earlier = None
            for i, j in tree_candidates([maps[r] for r in rows], size[rows], roots[rows], num, den):
                if earlier is None:
                    earlier = _membership([posts[r][: np.searchsorted(posts[r], block)] for r in rows])
                first = (np.maximum(own[rows[i]], own[rows[j]]) == step) & ~(earlier[i] & earlier[j]).any(axis=1)
                out.append(np.stack([rows[i[first]], rows[j[first]]]))
        i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        columns = [keys[i], keys[j], roots[i], roots[j], *(np.full(len(i), part[c].iloc[0]) for c in _GROUP)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    dealt = _dealt(narrow, num, den)
    schema = "a bigint, b bigint, ra bigint, rb bigint, bucket bigint, i int, j int"
    return dealt.join(_needed(members, dealt, ["map", "posts"]), "key").groupBy(*_GROUP).applyInPandas(walked, schema)


def _verified(near: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` that connect what the similar ones of the pairs ``near`` connect.

    The sets of a group's pairs come together once, whatever the number of pairs.
    """
    sides = near.select(*_GROUP, F.explode(F.array("a", "b")).alias("key")).distinct()
    of = {c: f"of_{c}" for c in _GROUP}  # names of their own: both sides come from ``near``
    sets = sides.join(_needed(members, sides, ["tokens"]), "key").withColumnsRenamed(of)

    def tested(pairs: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        tokens = {k: np.asarray(t, np.int64).view(np.uint64) for k, t in zip(part["key"], part["tokens"], strict=True)}
        names = np.unique(pairs[["ra", "rb"]].to_numpy())
        groups, found = Groups(names), []
        ends = np.searchsorted(names, pairs["ra"]).tolist(), np.searchsorted(names, pairs["rb"]).tolist()
        for a, b, x, y in zip(pairs["a"], pairs["b"], *ends, strict=True):
            if groups.root(x) != groups.root(y) and similar(tokens[a], tokens[b], num, den):
                groups.join(x, y)
                found.append((a, b))
        return pd.DataFrame({"a": [x for x, _ in found], "b": [x for _, x in found]}, dtype="int64")

    both = near.groupBy(*_GROUP).cogroup(sets.groupBy(*of.values()))
    return both.applyInPandas(tested, "a bigint, b bigint")


def _membership(lists: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each list: which of the numbers that several lists hold it has."""
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    number, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    rank = np.cumsum(count > 1) - 1
    shared = count[number] > 1
    at = rank[number[shared]]
    out = np.zeros((len(lists), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (of[shared], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out
