"""Small fixtures of the corpus operators: invented texts, copies, and rows that try the edges."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, score double, n_lines string"
SYLLABLES = {"en": "the tion er ing ou th an st wh ble".split(), "fr": "eux é que ai ment è ou tre le ç".split()}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed: int = 5, n: int = 60) -> list[str | None]:
    """Prose, exact and near copies, shared lines, and odd texts."""
    rng = random.Random(seed)
    out: list[str | None] = []
    shared = " ".join(words(rng, 40))
    for i in range(n):
        body = words(rng, rng.randint(30, 120), "fr" if i % 4 == 0 else "en")
        lines = [" ".join(body[j : j + 12]) for j in range(0, len(body), 12)]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        out.append("\n".join(lines))
    for i in range(0, n, 3):  # near copies: a few words changed
        copy = out[i].split(" ")
        for _ in range(1 + i % 4):
            copy[rng.randrange(len(copy))] = "changed"
        out.append(" ".join(copy))
    out += [out[1], out[1], out[2].upper()]
    out += [None, "", " \n\t ", "one two", "One  two", "x", "été naïve 日本語 \U0001f600", "a " * 3000, "z" * 5000]
    out += ["write to a.b@mail.example.org or +1 (555) 123-4567", "4111 1111 1111 1111 and 10.0.0.256 or 10.0.0.25"]
    return out


def rows(seed: int = 5, n: int = 60) -> list[tuple]:
    out = [(i * 3, t, "fr" if i % 4 == 0 else "en", "s", 1, 0.5, "own") for i, t in enumerate(texts(seed, n))]
    out.append(out[4])  # a repeated row
    out.append((None, out[3][1], None, None, None, None, None))
    return out
