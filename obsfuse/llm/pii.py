"""Personal data: candidate spans scored by boosted trees, beside spans that fixed patterns prove.

Generators propose overlapping spans of high recall (written-out addresses, digit chains and their
parts). Boosted trees score them by format and context. They learn from three kinds of examples:

* positive: the patterns' own hits, and each hit written in another form at its own place (an address
  with ``(at)`` and ``[dot]``, a number without its country code, with dots or spaces);
* negative: proposals that their own format or place disproves (a failed check digit, a letter or digit
  directly beside, an address of one label, a wrong cut of a positive), and hits turned into codes;
* unlabelled: all other proposals, which count as negative with a smaller weight.

Scores are calibrated for each kind by isotonic regression on rows that the trees have not seen; the
threshold of a kind is where the calibrated chance reaches the precision asked for. What the patterns
find always stays; a proposal that nothing disproves is added when its score is at or above the
threshold and it overlaps nothing chosen before it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.llm.boosting import Trees, codes, fit_counted
from obsfuse.llm.store import kept, text_batches, texts

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds (possessive or anchored where that changes no match).
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
_ADDRESS = re.compile(r"([A-Za-z0-9._%+-]{1,64})\x20?(?:@|[(\[]at[)\]])\x20?([A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63})*)", re.IGNORECASE)
_CHAIN = re.compile(r"\+?\(?[0-9](?:[\x20().\-]{0,2}[0-9]){6,}+")
_PART = re.compile(r"[^\x20]+")
_DOT = re.compile(r"\x20?(?:\.|[(\[]dot[)\]])\x20?", re.IGNORECASE)
_HINTS = (
    re.compile(r"mail|write|contact|correo|schreib", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr|ping", re.IGNORECASE),
    re.compile(r"card|visa|credit|karte|tarjeta|carte", re.IGNORECASE),
    re.compile(r"tel|phone|call|fax|mobil|ruf", re.IGNORECASE),
)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (1 + place % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns' hits: leftmost, without overlap within a kind."""
    out: list[Span] = []
    if "@" in text:
        free, seen, at = 0, 0, text.find("@")
        while at >= 0:
            lo = max(free, seen)
            start = lo + len(text[lo:at].rstrip(_LOCAL))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((0, start, m.end()))
                free = m.end()
            seen = at + 1
            at = text.find("@", max(seen, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def proposals(text: str) -> list[Span]:
    """Overlapping spans of every kind that may be personal data."""
    out: list[Span] = []
    for at in _AT.finditer(text):
        lo = max(0, at.start() - 65)
        for m in _ADDRESS.finditer(text[lo : at.end() + 192]):
            if m.start() <= at.start() - lo < m.end():
                ends = {m.end(), *(m.start(2) + dot.start() for dot in _DOT.finditer(m.group(2)))}
                out += [(0, lo + m.start(), lo + end) for end in sorted(ends)]
    if not _DIGIT.search(text):
        return out
    for chain in _CHAIN.finditer(text):
        spans = {(chain.start(), chain.end())}
        spans.update((chain.start() + m.start(), chain.start() + m.end()) for m in _PART.finditer(chain.group()))
        for start, end in spans:
            s = text[start:end]
            n = len(_digits(s))
            if s.count(".") == 3 and not set(s) - set("0123456789."):
                out.append((1, start, end))
            if 12 <= n <= 19:
                out.append((2, start, end))
            if 7 <= n <= 15:
                out.append((3, start, end))
    return out


def span_features(text: str, span: Span) -> list[float]:
    """Format of the span, the characters beside it, and hints in the 32 characters before it."""
    kind, start, end = span
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    labels = _labels(s) if kind == 0 else []
    return [
        *(float(kind == k) for k in range(4)),
        len(digits), end - start, len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"),
        s.startswith("+"), s.count("@"), "(" in s or "[" in s,
        13 <= len(digits) <= 19 and luhn(digits),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        len(set(digits)), len(labels), len(labels[-1]) if labels else 0, bool(labels) and labels[-1].isalpha(),
        before[-1:].isalnum(), before[-1:] in "\"'=", after.isalnum(), after in "\"'=", after == "@",
        before[-1:] in "-_/#:.", after in "-_/", ". " in s, bool(_DOT.match(text, end)), len(set(re.sub(r"[0-9]+", "", s))),
        *(bool(h.search(before)) for h in _HINTS),
    ]


def _labels(s: str) -> list[str]:
    """The labels of an address's host."""
    at = max(_AT.finditer(s), key=re.Match.start, default=None)
    return _DOT.split(s[at.end() :].strip()) if at else []


def disproved(text: str, span: Span) -> bool:
    """Whether the format of a proposal, or what stands directly beside it, shows that it is no personal data."""
    kind, start, end = span
    s, digits = text[start:end], _digits(text[start:end])
    if kind == 0:
        return len(_labels(s)) < 2
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return True
    if kind == 1:
        return any(not p or int(p) > 255 for p in s.split("."))
    return kind == 2 and not (len(digits) >= 13 and luhn(digits))


def rewritten(kind: int, s: str) -> tuple[list[str], list[tuple[str, int]]]:
    """A pattern's hit in other forms, and as codes that are no personal data (with the place of their digits)."""
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    if kind == 0:
        local, _, host = s.rpartition("@")
        forms = [f"{local}{at}{host.replace('.', dot)}" for at, dot in ((" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", " [dot] "))]
        return forms, [(f"{local} (at) {host.partition('.')[0]}", 0)]
    if kind == 2:
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(four), "  ".join(four)], [(f"{code}{digits}", len(code)) for code in ("AB-", "SKU")]
    if kind == 3:
        near = groups[1:] if len(groups) > 2 else groups
        forms = [sep.join(near) for sep in (" ", "-", ".")] if len(near) > 1 else []
        forms += [f"({near[0]}) {'-'.join(near[1:])}"] if len(near) > 1 else []
        code, d = "-".join(near), digits[-7:]
        day = f"20{d[:2]}-0{d[2]}-1{d[3]}"
        codes = [(f"{letters}{code}", len(letters)) for letters in ("AB-", "X/", "no_")]
        return forms, codes + [(c, 0) for c in (day, f"{day} 1{d[4]}", f"1{d[4]}.0{d[2]}.20{d[:2]}", f"20{d[:2]}-20{d[2:4]}", f"19{d[:2]} 20{d[2:4]}", f"{d[:3]}.{'.'.join(d[3:])}", f"978-{d[0]}-{d[1:3]}-{d[:6]}-{d[6]}")]
    return [], []


Example = tuple[list[float], float, float]


def examples(text: str, unlabelled: float = 0.5) -> list[Example]:
    """``(features, label, weight)`` of the proposals of a text and of its hits in other forms.

    Proposals that only overlap a hit of the patterns are neither.
    """
    base = base_spans(text)
    known, (starts, ends) = set(base), _merged((s, e) for _, s, e in base)
    out = []
    for p in proposals(text):
        if p in known:
            out.append((span_features(text, p), 1.0, 1.0))
        elif not _meets(starts, ends, p[1], p[2]):
            out.append((span_features(text, p), 0.0, 1.0 if disproved(text, p) else unlabelled))
    for kind, start, end in base:
        before, after = text[max(0, start - 64) : start], text[end : end + 64]
        forms, codes = rewritten(kind, text[start:end])
        made = [(f, 0, True) for f in forms] + [(c, at, False) for c, at in codes]
        for form, at, good in made:
            place = (kind, len(before) + at, len(before) + len(form))
            window = before + form + after
            for p in proposals(window):
                if p[0] == kind and p[1] < place[2] and p[2] > place[1]:
                    out.append((span_features(window, p), float(good and p == place), 1.0))
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _meets(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    at = bisect.bisect_right(ends, start)
    return at < len(starts) and starts[at] < end


@dataclass
class Finder:
    trees: Trees
    threshold: tuple[float, ...]

    def added(self, batch: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """For each text the proposals that are chosen beside its base spans, ties to the longer and then the earlier one."""
        known = [set(b) for b in base]
        found = [(i, p) for i, t in enumerate(batch) for p in proposals(t) if p not in known[i] and not disproved(t, p)]
        out: list[list[Span]] = [[] for _ in batch]
        if not found:
            return out
        score = self.trees.score(np.array([span_features(batch[i], p) for i, p in found], float))
        taken = [_merged((s, e) for _, s, e in b) for b in base]
        for k in np.lexsort(([p[1] for _, p in found], [p[1] - p[2] for _, p in found], -score)):
            i, (kind, start, end) = found[k]
            starts, ends = taken[i]
            if score[k] >= self.threshold[kind] and not _meets(starts, ends, start, end):
                out[i].append((kind, start, end))
                at = bisect.bisect_right(ends, start)
                starts.insert(at, start)
                ends.insert(at, end)
        return out


def calibrated_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The score from which on the chance, by isotonic regression, is at least ``precision``; 2 where it never is.

    Where no example lies between two blocks, the bound is half way between them in log-odds. Pooled adjacent violators over distinct scores; a block counts half an example against itself, so a
    few positive examples alone prove nothing.
    """
    values, at = np.unique(score, return_inverse=True)
    total = np.bincount(at, weight, len(values))
    hits = np.bincount(at, weight * label, len(values))
    blocks: list[tuple[float, float, float]] = []
    for v, h, t in zip(values, hits, total, strict=True):
        low = v
        while blocks and blocks[-1][1] * t >= h * blocks[-1][2]:
            low, more, all_ = blocks.pop()
            h, t = h + more, t + all_
        blocks.append((low, h, t))
    good = [low for low, h, t in blocks if h / (t + 0.5) >= precision]
    if not good:
        return 2.0
    first = int(np.searchsorted(values, good[0]))
    odds = np.log(np.clip(values, 1e-9, 1 - 1e-9) / (1 - np.clip(values, 1e-9, 1 - 1e-9)))
    return float(1 / (1 + np.exp(-(odds[first] + odds[first - 1]) / 2))) if first else float(values[0])


def example_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(code, label, test, weight)``: the distinct `examples` of all rows, in bins, with the sum of their weights.

    Equal rows (id and text) count once.  ``test`` holds for a third of the rows, by a hash.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every = examples(text)
                if not every:
                    continue
                sums: dict[tuple[bytes, float], float] = {}
                for code, (_, label, weight) in zip(codes(np.array([e[0] for e in every], float)), every, strict=True):
                    key = code.tobytes(), label
                    sums[key] = sums.get(key, 0.0) + weight
                ids.append(h)
                found.append([{"code": c, "label": y, "weight": w} for (c, y), w in sums.items()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(cell))], ["h", "cells"])

    cell = pa.struct([("code", pa.binary()), ("label", pa.float64()), ("weight", pa.float64())])
    rows = texts(docs, id_col, text_col).where("rlike(text, '[0-9@]')").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    once = rows.mapInArrow(listed, "h bigint, cells array<struct<code: binary, label: double, weight: double>>").dropDuplicates(["h"])
    test = F.pmod(F.xxhash64("h", F.lit("test")), F.lit(3)) == 0
    return once.select(test.alias("test"), F.inline("cells")).groupBy("code", "label", "test").agg(F.sum("weight").alias("weight"))


def fit_finder(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> Finder:
    """Fit on the examples of all rows, equal rows once.

    A third of the rows, by another hash, calibrates the scores and takes no part in the trees; scores are told apart
    there by 1/1024 of their log-odds.  A kind without enough positive examples to reach ``precision`` adds nothing.
    """
    cells = kept(example_cells(docs, id_col, text_col))
    trees = fit_counted(cells.where("NOT test"), len(span_features("", (0, 0, 0))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([list(c) for c in batch.column("code").to_pylist()], float)
                step = np.rint(np.clip(trees.odds(x), -30, 30) * 1024).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, : len(KINDS)].argmax(axis=1)), pa.array(step), batch.column("label"), batch.column("weight")], ["kind", "step", "label", "weight"])

    known = cells.where("test").mapInArrow(scored, "kind bigint, step bigint, label double, weight double")
    known = known.groupBy("kind", "step", "label").agg(F.sum("weight").alias("weight")).toPandas()
    limits = []
    for k in range(len(KINDS)):
        of = known[known["kind"] == k]
        score = 1 / (1 + np.exp(-of["step"].to_numpy(float) / 1024))
        limits.append(calibrated_threshold(score, of["label"].to_numpy(float), of["weight"].to_numpy(float), precision))
    return Finder(trees, tuple(limits))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the kind of its first one."""
    out, at, stop = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda p: (p[1], -p[2], p[0])):
        if start >= stop:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        stop = max(stop, end)
        at = stop
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans, redacted)`` for every row: the patterns' spans, all spans (arrays of
    kind, start, end in code points) and the text without them.

    Null and empty texts have no spans and an empty redacted text; null ids stay null; repeated
    rows give equal results. Columns beside id and text are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def shown(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column(1).to_pylist()
                base = [base_spans(t) for t in text]
                both = [b + a for b, a in zip(base, finder.added(text, base), strict=True)]
                columns = [pa.array([shown(b) for b in base], kind), pa.array([shown(b) for b in both], kind)]
                clean = pa.array([redacted(t, b) for t, b in zip(text, both, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, clean], ["doc_id", "base", "spans", "redacted"])

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    out = texts(docs, id_col, text_col).mapInArrow(found, f"doc_id bigint, base {span}, spans {span}, redacted string")
    return out.withColumnRenamed("doc_id", id_col)


def redact(docs: DataFrame, finder: Finder, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans in the text replaced by their kind, as ``[EMAIL]``; null texts stay null.

    Other columns, the number of rows and nulls stay; nothing is shuffled.
    """

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in text_batches(batches, text_col):
            text = column.to_pylist()
            base = [base_spans(t) for t in text]
            both = [b + a for b, a in zip(base, finder.added(text, base), strict=True)]
            at = batch.schema.get_field_index(text_col)
            known = batch.column(at).is_valid().to_pylist()
            new = [redacted(t, b) if ok else None for t, b, ok in zip(text, both, known, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(cleaned, docs.schema)
