"""Small tables with nulls, empty texts, repeats and clashing columns, and plain versions of what the operators do."""

from __future__ import annotations

import random

SYLLABLES = "al be cor den el fi gra hon il jun ka lo mer nis or pel qua ri sto tur ul ven wis yor zan".split()
WORDS = "the of and to in is".split() * 12 + [a + b + c for a in SYLLABLES for b in SYLLABLES[::3] for c in SYLLABLES[1::4]]


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randint(4, 12))
        out += ["".join(rng.choice(WORDS) + str(rng.randint(0, 99)) if rng.random() < 0.5 else rng.choice(WORDS)) for _ in range(k)]
    return " ".join(out)


def documents(seed: int = 5) -> list[tuple]:
    """(doc_id, text): prose, exact and near copies, shared lines, repeats, nulls and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 220)) for _ in range(24)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(6):
        words = base[k].split()
        for copy in range(3):
            near = list(words)
            for _ in range(1 + copy * 2):
                near[rng.randrange(len(near))] = "changed" + str(rng.randint(0, 999))
            rows.append((100 + 10 * k + copy, " ".join(near)))
        rows.append((200 + k, base[k]))
    line = "This very line stands in many of the documents of this table, again and again."
    rows += [(300 + k, f"{base[k]}\n  {line.upper() if k % 2 else line} \n\n{base[k + 1]}") for k in range(7)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "two words"), (404, "Two\x0bWORDS"), (405, prose(rng, 6000)), (405, prose(rng, 30))]
    rows += [rows[0], rows[0], (None, base[0]), (None, None)]
    return rows


def table(spark, rows: list[tuple]):
    """The rows with columns whose names operators use inside."""
    schema = "doc_id long, text string, set long, n int, __e string, copy long"
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema)


def components(nodes, links) -> dict:
    top = {x: x for x in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}
