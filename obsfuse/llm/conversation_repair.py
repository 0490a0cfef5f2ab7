"""Conversation structure repair: the cheapest edits that give alternating turns, and among them the
ones whose audit (the initials of the edits) comes first in ASCII order.

The rows of a conversation and the four states of the role pattern ``(s?(ua)+)?`` span a graph; its arcs are
the edits. Costs are found first: each row is a 4x4 table of costs between states, and min-plus products
of 1, 2, 4, ... rows give the cost from every node to the end. Arcs that lie on cheapest paths stay. Their
nodes are ranked by the next 1, 2, 4, ... letters of their audits: a rank of twice the length is the rank of
the pair (own rank, rank of the node that the doubled pointer names). Of the arcs of a node the one with
the least letter, then the least rank behind it, is its way on; the doubled pointers then lay out whole paths.

A conversation may be of any size. Rows are cut by range into slices, a task holds one slice, and a
conversation that crosses slices is carried on by small tables: its cost tables are multiplied along the
slices by doubling joins, and so are the maps from the state before a slice to the state behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept
from obsfuse.runtime import attach

#: Rows (equal ones counted once) of a slice.
SLICE_ROWS = 100_000

START, SYSTEM, USER, ANSWER = range(4)
#: The state after one more user or assistant row.
NEXT = np.array([USER, USER, ANSWER, USER])
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAR = np.int64(1) << 60
#: Cost of insertions between states, and from a state to an end of the pattern.
MOVE = np.full((4, 4), FAR)
MOVE[np.arange(4), np.arange(4)] = 0
MOVE[np.arange(4), NEXT] = INSERT
MOVE[[START, SYSTEM], ANSWER] = 2 * INSERT
CLOSE = np.minimum(MOVE[:, START], MOVE[:, ANSWER])
#: Edits by letter; numbers follow the order of the letters, 0 ends a path.
LETTERS = np.frombuffer(b".DIKR", np.uint8)
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: White space of a text, beside the characters that may end it.
SPACES, STOPS = "\t\n\x0b\x0c\r ", ".!?"


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` of a table of conversations with seeded damage; nulls are one space.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (no copies), 1 empties its text, 2 takes
    its ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it a user's row.
    """
    draw = F.pmod(F.crc32(F.concat(_said("conv_id"), F.lit(":"), _said("turn"))), F.lit(20))
    text = F.when(draw == 1, "").when(draw == 2, F.translate(_said("text"), STOPS, "")).otherwise(_said("text"))
    role = F.when(draw == 4, "user").otherwise(_said("role"))
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _named(turns: DataFrame) -> DataFrame:
    """With two hashes of conversation, role and text, which name a row and order rows of one turn."""
    turns = turns.where("copies > 0").select("conv_id", "turn", _said("role").alias("role"), _said("text").alias("text"), "copies")
    return turns.withColumn("h1", F.xxhash64("role", "text", "conv_id")).withColumn("h2", F.xxhash64("text", "conv_id", "role"))


def _faulty(turns: DataFrame) -> DataFrame:
    """One row for all equal rows: ``(conv_id, turn, h1, h2, code, copies, fault, more)``, where ``fault`` is that of
    the first copy, ``more`` the fault of the others, ``code`` the state that the role's initial belongs to.
    """
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ANSWER).otherwise(0)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    own = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(*STOPS), TRUNCATED).otherwise(FINE)
    rows = _named(turns).select("conv_id", "turn", "h1", "h2", code.alias("code"), own.alias("own"), "copies")
    rows = kept(rows.groupBy("conv_id", "turn", "h1", "h2").agg(F.min("code").alias("code"), F.min("own").alias("own"), F.sum("copies").alias("copies")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("h1", "h2").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = attach(rows, first.drop("n"), ["h1", "h2"], salt_by=["turn"])
    blank, later = F.col("own") == BLANK, F.col("first").isNotNull() & (F.col("first") != when)
    fault = F.when(later & ~blank, DUPLICATE).otherwise(F.col("own"))
    more = F.when(blank, BLANK).otherwise(DUPLICATE)
    return rows.select("conv_id", "turn", "h1", "h2", "code", "copies", fault.alias("fault"), more.alias("more"))


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """``rows`` with the number of the slice of the whole order that each lies in."""
    n = rows.count() // slice_rows + 1
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "h1", "h2")]
    return kept(rows.repartitionByRange(n, *by).withColumn("slice", F.spark_partition_id()))


class Slice:
    """The graph of one slice: its rows in order, its conversations, and a row of four nodes ahead of each row
    and behind the last one of each conversation.
    """

    def __init__(self, table: pa.Table) -> None:
        keys = [(c, "ascending") for c in ("conv_id", "turn", "h1", "h2")]
        table = table.take(pc.sort_indices(table, keys, null_placement="at_start")).combine_chunks()
        code, copies, fault = (table[c].to_numpy().astype(np.int64) for c in ("code", "copies", "fault"))
        conv = table["conv_id"].to_pylist()
        begins = np.array([i == 0 or conv[i] != conv[i - 1] for i in range(len(conv))], bool)
        self.convs = [conv[i] for i in np.flatnonzero(begins)]
        # pairs of neighbouring rows whose roles may not follow each other
        fits = ((code[:-1] == SYSTEM) & (code[1:] == USER)) | ((code[:-1] == USER) & (code[1:] == ANSWER)) | ((code[:-1] == ANSWER) & (code[1:] == USER))
        wrong = copies - 1
        wrong[1:] += ~fits & ~begins[1:]
        self.illegal = np.add.reduceat(wrong, np.flatnonzero(begins))
        at = np.flatnonzero(begins)
        self.first, self.last = code[at], code[np.append(at[1:], len(code)) - 1]
        # a row for the first copy, and one for all others, which can only be deleted together
        rest = np.flatnonzero(copies > 1)
        order = np.argsort(np.concatenate([np.arange(len(code)), rest + 0.5]), kind="stable")
        self.code = np.concatenate([code, code[rest]])[order]
        self.many = np.concatenate([np.ones(len(code), np.int64), copies[rest] - 1])[order]
        keep = np.select([fault == FINE, fault == TRUNCATED], [0, CUT_OFF], FAR)
        self.keep = np.concatenate([keep, np.full(len(rest), FAR)])[order]
        begins = np.concatenate([begins, np.zeros(len(rest), bool)])[order]
        self.starts = np.flatnonzero(begins)
        self.stops = np.append(self.starts[1:], len(self.code))
        self.owner = np.cumsum(begins) - 1
        n = len(self.code)
        rows = np.full((n, 4, 4), FAR)
        states = np.arange(4)
        rows[:, states, NEXT] = (self.keep + REROLE)[:, None]
        for state in range(4):
            match = self.code == NEXT[state]
            rows[match, state, NEXT[state]] = self.keep[match]
        lead = self.code == SYSTEM
        rows[lead, START, SYSTEM] = self.keep[lead]
        rows[:, states, states] = DELETE * self.many[:, None]
        self.tables = _product(np.broadcast_to(MOVE, rows.shape), rows)
        self._double()

    def _double(self) -> None:
        """Tables from each row to the end of its conversation, by products of doubled length."""
        n, width = len(self.code), 1
        end = self.stops[self.owner]
        while True:
            at = np.flatnonzero(np.arange(n) + width < end)
            if not len(at):
                return
            self.tables[at] = _product(self.tables[at], self.tables[at + width])
            width *= 2

    def paths(self, behind: dict[int, tuple[np.ndarray, bool]]) -> list[tuple[int, int, int, int, bytes]]:
        """``(conversation, entry, exit, cost, audit)`` of the least cheapest path from each entry state.

        ``behind`` gives, for conversations that cross the bounds of the slice, the cost from each state behind
        their rows here, and whether they go on; the others begin in START and end where the pattern does.
        """
        n, many_convs = len(self.code), len(self.starts)
        close = np.repeat(CLOSE[None], many_convs, axis=0)
        for c, (far, _) in behind.items():
            close[c] = far
        cost = np.full((n + many_convs, 4), FAR)
        place = np.arange(n) + self.owner
        end = self.stops + np.arange(many_convs)
        cost[end] = close
        cost[place] = np.minimum(FAR, (self.tables + close[self.owner][:, None, :]).min(axis=2))
        goes_on = np.zeros(many_convs, bool)
        goes_on[[c for c, (_, on) in behind.items() if on]] = True

        node = np.arange(4)
        arcs = []  # source, letter, target, copies

        def add(rows: np.ndarray, states: np.ndarray, letter: int, targets: np.ndarray, price: np.ndarray, count: np.ndarray) -> None:
            source = rows[:, None] * 4 + states[None, :]
            price = np.broadcast_to(price[:, None], source.shape)
            left = cost.ravel()[source]
            tight = (left < FAR) & (left == price + cost.ravel()[targets])
            arcs.append(np.stack([source[tight], np.full(tight.sum(), letter), targets[tight], np.broadcast_to(count[:, None], source.shape)[tight]]))

        one = np.ones(n, np.int64)
        add(place, node, 1, (place[:, None] + 1) * 4 + node, DELETE * self.many, self.many)
        inner = np.concatenate([place, end[~goes_on]])
        ones = np.ones(len(inner), np.int64)
        add(inner, node, 2, inner[:, None] * 4 + NEXT, INSERT * ones, ones)
        for state in range(4):
            match = self.code == NEXT[state]
            add(place[match], node[state : state + 1], 3, (place[match, None] + 1) * 4 + NEXT[state], self.keep[match], one[match])
        lead = self.code == SYSTEM
        add(place[lead], node[:1], 3, (place[lead, None] + 1) * 4 + SYSTEM, self.keep[lead], one[lead])
        add(place, node, 4, (place[:, None] + 1) * 4 + NEXT, self.keep + REROLE, one)
        source, letter, target, count = np.concatenate(arcs, axis=1)

        way, said, jumps = _ranked(cost.size, source, letter, target)
        copies = np.zeros(cost.size, np.int64)
        copies[source[way[source] == target]] = count[way[source] == target]
        out = []
        entries = [(c, s) for c in range(many_convs) for s in (range(4) if c in behind else (START,))]
        begin = np.array([(self.starts[c] + c) * 4 + s for c, s in entries])
        steps = np.zeros(cost.size, np.int64)
        steps[said > 0] = 1
        for jump in jumps:
            steps = steps + steps[jump]
        for (c, s), first, path in zip(entries, begin, _walks(begin, steps[begin], jumps), strict=True):
            letters = np.repeat(LETTERS[said[path]], copies[path])
            last = jumps[-1][first]
            out.append((c, s, int(last % 4), int(cost.ravel()[first]), letters.tobytes()))
        return out


def _product(a: np.ndarray, b: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """Min-plus products of tables of costs."""
    out = np.empty(a.shape, np.int64)
    for i in range(0, len(a), rows):
        out[i : i + rows] = np.minimum(FAR, (a[i : i + rows, :, :, None] + b[i : i + rows, None, :, :]).min(axis=2))
    return out


def _ranked(nodes: int, source: np.ndarray, letter: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The way on from each node (itself at an end), its letter (0 there), and the doubled pointers.

    Each round picks the arc of a node by its letter and the rank of its target so far, and doubles the length
    that the ranks compare; it ends when every pointer has come to an end.
    """
    rank, way, jumps = np.zeros(nodes, np.int64), np.arange(nodes), []
    while True:
        order = np.lexsort((rank[target], letter, source))
        head = np.ones(len(order), bool)
        head[1:] = source[order[1:]] != source[order[:-1]]
        best = order[head]
        chosen, said = np.arange(nodes), np.zeros(nodes, np.int64)
        chosen[source[best]], said[source[best]] = target[best], letter[best]
        rounds = len(jumps)
        if not rounds or (chosen != way).any():
            way, jumps, rank = chosen, [chosen], said  # ranks of one letter
            rounds = max(0, rounds - 1)
        else:
            rounds = 1
        for _ in range(rounds):
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[jumps[-1]], return_inverse=True)[1]
            jumps.append(jumps[-1][jumps[-1]])
        if not said[jumps[-1]].any():
            return way, said, jumps


def _walks(begin: np.ndarray, steps: np.ndarray, jumps: list[np.ndarray]) -> list[np.ndarray]:
    """The nodes of the paths from ``begin``, filled in by pointers of falling length."""
    ends = np.cumsum(steps)
    owner = np.repeat(np.arange(len(begin)), steps)
    place = np.arange(len(owner)) - (ends - steps)[owner]
    nodes = begin[owner]
    for k in range(len(jumps) - 1, -1, -1):
        at = np.flatnonzero((place >> k) & 1)
        at = at[(place[at] & ((1 << k) - 1)) == 0]
        nodes[at] = jumps[k][nodes[at - (1 << k)]]
    return np.split(nodes, ends[:-1])


SEGMENT = "slice int, costs array<bigint>, head int, tail int"
PATH = "slice int, entry int, exit int, cost bigint, audit binary, illegal bigint"


def _segments(table: pa.Table) -> pa.Table:
    """Cost tables of the first and the last conversation of a slice, which may go on in others."""
    part = Slice(table)
    at = sorted({0, len(part.convs) - 1})
    costs = [part.tables[part.starts[c]].ravel() for c in at]
    columns = [
        pa.array([part.convs[c] for c in at], table.schema.field("conv_id").type),
        pa.array([table["slice"][0].as_py()] * len(at), pa.int32()),
        pa.array(costs, pa.list_(pa.int64())),
        pa.array(part.first[at], pa.int32()),
        pa.array(part.last[at], pa.int32()),
    ]
    return pa.table(columns, ["conv_id", "slice", "costs", "head", "tail"])


def _audits(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """Paths of a slice; ``ends`` holds the costs behind the slice of conversations that cross its bounds."""
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in (rows.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())], ["conv_id", "slice", "entry", "exit", "cost", "audit", "illegal"])
    part = Slice(rows)
    known = {row["conv_id"]: (np.array(row["behind"], np.int64), row["on"]) for row in ends.to_pylist()}
    found = part.paths({c: known[conv] for c, conv in enumerate(part.convs) if conv in known})
    conv, entry, leave, cost, audit = zip(*found, strict=True)
    columns = [
        pa.array([part.convs[c] for c in conv], rows.schema.field("conv_id").type),
        pa.array([rows["slice"][0].as_py()] * len(conv), pa.int32()),
        pa.array(entry, pa.int32()),
        pa.array(leave, pa.int32()),
        pa.array(cost, pa.int64()),
        pa.array(audit, pa.binary()),
        pa.array(part.illegal[list(conv)], pa.int64()),
    ]
    return pa.table(columns, ["conv_id", "slice", "entry", "exit", "cost", "audit", "illegal"])


def _along(rows: DataFrame, value: str, step: int, combined: str, longest: int) -> DataFrame:
    """``value`` combined over all rows of a conversation ahead of (``step`` 1) or up to (-1) each, by doubling joins.

    ``combined`` says how ``own`` and ``other`` (the value of the row that is so many places away) go together.
    """
    width = 1
    while width < longest:
        far = rows.select(F.col("conv_id").alias("__conv"), (F.col("seq") - step * width).alias("__seq"), F.col(value).alias("other"))
        on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("seq") == F.col("__seq"))
        both = rows.withColumnRenamed(value, "own").join(far, on, "left").drop("__conv", "__seq")
        rows = kept(both.withColumn(value, F.expr(f"CASE WHEN other IS NULL THEN own ELSE {combined} END")).drop("own", "other"))
        width *= 2
    return rows


_MIN_PLUS = f"""transform(sequence(0, 15), x -> least({FAR}L, array_min(transform(sequence(0, 3),
    k -> own[cast(x div 4 AS int) * 4 + k] + other[k * 4 + x % 4]))))"""


def edit_plans(turns: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for each conversation with rows.

    ``turns`` has ``(conv_id, turn, role, text, copies)``: ``copies`` equal rows, 0 for none. Rows go by turn, null turns
    first; different rows of one turn go by a hash of role and text. A null role or text is one space; a null
    conversation is one as well. The first fault of a row counts: blank, duplicate (role and text occur earlier in the
    conversation), truncated (the last character that is no space does not end a sentence). ``illegal`` counts
    neighbours whose roles' initials are not su, ua or au. ``gaps`` are missing numbers between the turns.

    Keeping a row costs 0, another role 1, deletion 2 (the only way for blank and duplicate rows), an inserted
    user or assistant row 5, and 5 more for each truncated row that stays. ``audit`` spells the cheapest edits
    (D, I, K, R) in order, the least one in ASCII order. Texts of any length are read whole; empty tables give none.
    """
    rows = kept(_faulty(turns))
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") != BLANK, F.col("copies") - 1).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated"),
    )
    rows = _sliced(rows.drop("more"), slice_rows)
    kind = dict(rows.dtypes)["conv_id"]
    segments = rows.groupBy("slice").applyInArrow(_segments, f"conv_id {kind}, {SEGMENT}")
    of_conv = Window.partitionBy("conv_id")
    segments = segments.withColumn("seq", F.row_number().over(of_conv.orderBy("slice")) - 1).withColumn("n", F.count("*").over(of_conv))
    segments = kept(segments.where("n > 1"))
    longest = segments.agg(F.max("n")).first()[0] or 0

    total = _along(segments, "costs", 1, _MIN_PLUS, longest)
    close = f"array({', '.join(f'{c}L' for c in CLOSE)})"
    total = total.withColumn("from", F.expr(f"transform(sequence(0, 3), s -> least({FAR}L, array_min(transform(sequence(0, 3), k -> costs[s * 4 + k] + {close}[k]))))"))
    total = kept(total.select("conv_id", "slice", "seq", "from", "head", "tail"))
    later = total.select(F.col("conv_id").alias("__conv"), (F.col("seq") - 1).alias("__seq"), F.col("from").alias("behind"), F.col("head").alias("follows"))
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("seq") == F.col("__seq"))
    ends = kept(total.join(later, on, "left").select("conv_id", "slice", "seq", "tail", "follows", F.coalesce("behind", F.expr(close)).alias("behind")))

    paths = rows.groupBy("slice").cogroup(ends.select("conv_id", "slice", "behind", F.col("follows").isNotNull().alias("on")).groupBy("slice")).applyInArrow(_audits, f"conv_id {kind}, {PATH}")
    paths = kept(paths)
    crossing = ends.select(F.col("conv_id").alias("__conv"), F.col("slice").alias("__slice"), "seq", "tail", "follows")
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("slice") == F.col("__slice"))
    marked = paths.join(crossing, on, "left").drop("__conv", "__slice")
    whole = marked.where("seq IS NULL").select("conv_id", "illegal", "cost", F.col("audit").cast("string").alias("audit"))
    pieces = kept(marked.where("seq IS NOT NULL"))
    maps = pieces.groupBy("conv_id", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry", "exit"))), lambda p: p["exit"]).alias("map"))
    upto = _along(maps, "map", -1, "transform(other, s -> own[s])", longest)
    entry = upto.select(F.col("conv_id").alias("__conv"), (F.col("seq") + 1).alias("__seq"), F.expr(f"map[{START}]").alias("enter"))
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("seq") == F.col("__seq"))
    pieces = pieces.join(entry, on, "left").where(F.col("entry") == F.coalesce("enter", F.lit(START)))
    legal = "(tail = 1 AND follows = 2) OR (tail = 2 AND follows = 3) OR (tail = 3 AND follows = 2)"
    across = F.expr(f"illegal + CASE WHEN follows IS NULL OR {legal} THEN 0 ELSE 1 END")
    joined = pieces.groupBy("conv_id").agg(
        F.sum(across).alias("illegal"),
        F.max(F.when(F.col("seq") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "audit"))), lambda p: p["audit"].cast("string")), "").alias("audit"),
    )
    plans = whole.union(joined).withColumnRenamed("conv_id", "__conv")
    out = counts.join(plans, F.col("conv_id").eqNullSafe(F.col("__conv"))).withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return out.select("conv_id", *[F.col(c).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "audit")


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the rows that stay or are inserted, from place 0 on.

    The rows of a conversation follow each other in one partition, sorted on disk and read as a stream, so that
    only its audit is in memory.
    """
    heads = plans.select("conv_id", F.lit(0).alias("tag"), "audit")
    rows = _named(turns).withColumn("tag", F.lit(1))
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "tag", "turn", "h1", "h2")])
    kind = dict(turns.dtypes)["conv_id"]
    return both.select("conv_id", "tag", "audit", "role", "text", "copies").mapInArrow(_edit, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {USER: "user", ANSWER: "assistant"}
    own = {"s": SYSTEM, "u": USER, "a": ANSWER}
    conv, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def say(letter: str, role: str | None, text: str) -> None:
        nonlocal state, place
        state = int(NEXT[state]) if role is None else own[role[0]]
        out.append((conv, place, letter, names[state] if role is None else role, text))
        place += 1

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            say("I", None, "")
            at += 1

    def taken(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "tag", "audit", "role", "text", "copies")), strict=True):
            if row[1] == 0:
                inserts()  # those behind the last row of the conversation before
                conv, audit, at, state, place = row[0], row[2], 0, START, 0
                continue
            for _ in range(row[5]):
                inserts()
                letter, at = audit[at], at + 1
                if letter != "D":
                    say(letter, row[3] if letter == "K" else None, row[4])
        yield taken(kind)
    inserts()
    if out:
        yield taken(kind)


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text`` of ``repaired_turns``, joined by line feeds."""
    kind = dict(repaired.dtypes)["conv_id"]
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if row[1] == 0:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = row[0], hashlib.sha256()
            running.update(f"{chr(10) if row[1] else ''}{row[2]}:{row[3]}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([running.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])
