"""Conversation repair, quality scores and whitening against plain versions."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiwave.llm import conversation_repair as repair
from epiwave.llm import quality_qda, whitening
from tests.llm import helpers

# ---- conversation repair ----


def plain_repair(turns):
    """Cheapest (cost, audit) of turns (initial, fault): a recursion over all edits, from the grammar's own states."""
    n = len(turns)

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == n and state in "na" else []
        to = "a" if state == "u" else "u"
        if inserted < 2:
            ways += [(c + 3, "I" + a) for c, a in best(i, to, inserted + 1)]
        if i < n:
            initial, fault = turns[i]
            ways += [(c + 4, "D" + a) for c, a in best(i + 1, state, 0)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if initial == "s" and state == "n":
                    ways += [(c + extra, "K" + a) for c, a in best(i + 1, "s", 0)]
                edit, more = ("K", 0) if initial == to else ("R", 3)
                ways += [(c + more + extra, edit + a) for c, a in best(i + 1, to, 0)]
        return [min(ways)] if ways else []

    for i in range(n, -1, -1):  # from the end, so that the recursion stays flat
        for state in "nsua":
            best(i, state, 1)
    return best(0, "n", 0)[0]


def random_turns(rng, most):
    return tuple((rng.choice("ssuuuaaat"), rng.choice(["", "", "", *repair.FAULTS])) for _ in range(rng.randint(1, most)))


def test_alignment_finds_the_least_audit():
    rng = random.Random(4)
    for _ in range(200):
        turns = random_turns(rng, 10)
        found = repair.repairs(turns, repair.NOTHING)
        assert min(v for e, v in found.items() if e in repair.ACCEPTED) == plain_repair(turns)
        k = rng.randint(1, len(turns))
        parts = [{(b, e): v for b in range(4) for e, v in repair.repairs(p, b).items()} for p in (turns[:k], turns[k:]) if p]
        assert min(v for (b, e), v in repair.joined(parts).items() if b == 0 and e in repair.ACCEPTED) == plain_repair(turns)


BLANKS = " \t\n\x0b\x0c\r"


def plain_digest(rows):
    """conv_id -> the columns of ``repair_digest`` without damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv),
            key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()),
        )
        seen, key = set(), []
        for _, _, role, text in turns:
            body = text.rstrip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            key.append((role[:1], fault))
        known = {t for has, t, _, _ in turns if has}
        cost, audit = plain_repair(tuple(key))
        made, place = [], iter(turns)
        for e in audit:
            role, text = next(place)[2:] if e != "I" else ("", "")
            odd = (len(made) - (bool(made) and made[0][0][:1] == "s")) % 2
            if e != "D":
                made.append((role if e == "K" else "assistant" if odd else "user", text))
        out[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0, *(sum(f == x for _, f in key) for x in repair.FAULTS),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(key, key[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


def conversations():
    rng = random.Random(11)
    texts = ["Hi there.", "hm", "So?", " \t", "", "One.\n", "é!", "x" * 100_000 + ".", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(c, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"w {rng.random()}.") for c in range(40) for _ in range(rng.randint(1, 9))]
    rows += [(None, rng.randint(0, 3000), rng.choice(roles), f"t {k}{rng.choice(['.', ''])}") for k in range(700)]
    rows += [(77, None, None, None)] * 3 + [(78, 5, "user", "Same."), (78, 5, "user", "Same.")]
    return rows


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, place long, seg string")


COLUMNS = ("gaps", *repair.FAULTS, "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_long_odd_and_repeated_conversations(spark):
    rows = conversations()
    frame = chat_table(spark, rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_digest(frame, frame).collect()}
    assert got == plain_digest(rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = repair.numbered_turns(chat_table(spark, conversations()))
    found = repair.audits(rows)
    made = {}
    for r in repair.repaired_turns(rows, found).collect():
        made.setdefault(r.conv_id, []).append((r.place, r.role[0], r.edit))
    for conv, turns in made.items():
        turns.sort()
        assert [p for p, _, _ in turns] == list(range(len(turns)))
        said = "".join(i for _, i, _ in turns).removeprefix("s")
        assert said and said == "ua" * (len(said) // 2), conv


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (0, 1, None) for t in (*range(60), None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "A b c" if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, repair.damaged(chat_table(spark, rows)).collect()))) == sorted(map(str, want))


def test_repair_of_nothing(spark):
    frame = chat_table(spark, [(3, 1, "user", "x.")])
    assert [tuple(r)[1:] for r in repair.repair_digest(frame.limit(0), frame).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_digest(frame.limit(0), frame.limit(0)).collect() == []


# ---- quality scores ----


def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(600):
        good, text = k % 3 > 0, helpers.prose(rng, rng.randint(8, 120))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(text.split()[:1] * 60), text.replace(" ", " | ")])
        docs.append((k, text))
        labels.append((k, int(good)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, "no id here"), (1003, helpers.prose(rng, 30_000)), docs[0], docs[0]]
    labels += [(5000, 1), (7, None), (8, 9), (None, 1)]
    return docs, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*r, "x", 2.0) for r in labels], "doc_id long, quality int, x string, score double")


def test_quality_scores_tell_junk_from_prose(spark):
    docs, labels = labelled(spark)
    got = quality_qda.quality_scores(helpers.table(spark, docs), label_table(spark, labels)).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {d: y for d, y in labels if y in (0, 1)}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 100 and sum(r.predicted == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_quality_scores_match_plain_densities(spark):
    docs, labels = labelled(spark)
    how = quality_qda.Shrinkage(pool=0.2, ridge=0.05)
    got = quality_qda.quality_scores(helpers.table(spark, docs), label_table(spark, labels), how).collect()
    texts, rows = dict(docs), []
    for d, y in labels:
        if y in (0, 1) and d is not None and d in texts and zlib.crc32(str(d).encode()) % 3 != 1:
            rows += [(y, quality_qda.document_statistics(t)) for k, t in docs if k == d]
    x, y = np.array([v for _, v in rows]), np.array([c for c, _ in rows])
    scale = np.where(x.std(axis=0) > 1e-6, x.std(axis=0), 1.0)
    pooled = sum((y == c).mean() * np.cov((x / scale)[y == c].T, bias=True) for c in (0, 1))

    def density(v, c):
        part = (x / scale)[y == c]
        cov = 0.8 * np.cov(part.T, bias=True) + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        apart = v / scale - part.mean(axis=0)
        return np.log((y == c).mean()) - np.linalg.slogdet(cov)[1] / 2 - apart @ np.linalg.solve(cov, apart) / 2

    for r in got[::7]:
        text = next(t for d, t in docs if d == r.doc_id and (d != 405))
        v = np.array(quality_qda.document_statistics(text))
        odds = density(v, 1) - density(v, 0)
        assert r.score == pytest.approx((1 + odds / (1 + abs(odds))) / 2, abs=1e-6)


def test_quality_scores_of_few_labels(spark):
    docs, labels = labelled(spark)
    frame = helpers.table(spark, docs)
    scores = lambda rows: {r.score for r in quality_qda.quality_scores(frame, label_table(spark, rows)).collect()}
    assert scores([]) == {0.5}
    assert scores([r for r in labels if r[1] == 1]) == {1.0}
    assert quality_qda.quality_scores(frame.limit(0), label_table(spark, labels)).collect() == []


# ---- whitening ----


@pytest.mark.parametrize("d, n", [(1, 6), (3, 2), (12, 200), (40, 90)])
def test_rank_one_updates_keep_the_spectrum(d, n):
    rng = np.random.default_rng(d)
    x = rng.integers(-700, 700, (n, d)) + whitening.SHIFT
    if d > 5:
        x[:, 1], x[:, 4] = x[:, 0], 5
    halves = [whitening.Spectrum(d), whitening.Spectrum(d)]
    for k, row in enumerate(x):
        halves[k % 3 == 0].add(row)
    halves[0].merge(halves[1])
    s, c = halves[0], x - x.mean(axis=0)
    scatter = c.T @ c
    assert s.n == n and s.sums == x.sum(axis=0).tolist()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() <= 1e-11 * max(scatter.max(), 1)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, x string, n int")


def test_whitening_matches_a_plain_decomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 10)) * np.linspace(1, 0.1, 10)).astype("f4")
    vectors[150:200] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [float("inf")] * 10), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(vector_table(spark, rows + bad)).collect()
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 8 * n and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    deviations = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for k, row in enumerate(x)}
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        want = c @ u[:, k] / np.sqrt(e[k])
        white = np.array([mine[i].whitened for i in range(n)])
        assert min(np.abs(white - want).max(), np.abs(white + want).max()) < 1e-9
        assert mine[0].explained == pytest.approx(e[k] / np.trace(v), rel=1e-9)
        assert all(mine[i].deviation == deviations[i] for i in range(n))


def test_whitening_without_variance_or_rows(spark):
    same = whitening.whiten(vector_table(spark, [(k, [1.0, 2.0, 3.0]) for k in range(5)])).collect()
    assert len(same) == 15 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    flat = whitening.whiten(vector_table(spark, [(k, [float(k), 2.0]) for k in range(5)])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 5 + [True] * 5
    assert whitening.whiten(vector_table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vector_table(spark, [(1, [1.0])]).limit(0)).collect() == []
    far = vector_table(spark, [(k, [1e12 * (-1) ** k, 1.0]) for k in range(2)])
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_whitening_combines_many_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)]
    one = whitening.whiten(vector_table(spark, rows).coalesce(1))
    many = whitening.whiten(vector_table(spark, rows).repartition(20, F.col("vec_id")))
    a, b = ({(r.vec_id, r.component): abs(r.whitened) for r in f.collect()} for f in (one, many))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
