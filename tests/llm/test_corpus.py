"""Operators over whole tables, against plain versions."""

import json
import os
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm import helpers
from tokenizers import Tokenizer

import corpus_pipeline
from epiwave.llm import common, components, embedding_dedup, line_dedup, ngram_join, packing, quality

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- packing ----


def plain_pieces(rows, size):
    tokenizer, out = Tokenizer.from_file(WORD_BPE), []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(doc, k // size, k, len(ids[k : k + size]), zlib.crc32(ids[k : k + size].tobytes())) for k in range(0, len(ids), size)]
    return out


def assert_packed(got, caps):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1])
        assert sum(n for _, n in places) <= caps.tokens and len(places) <= caps.documents
        assert sum(n * n for _, n in places) <= caps.attention
    return len(bins)


@pytest.mark.parametrize("caps", [
    packing.Capacities(tokens=256, documents=256, attention=256 * 256),
    packing.Capacities(tokens=256, documents=3, attention=70_000),
    packing.Capacities(tokens=256, documents=256, attention=256 * 256, rule="dot_product", weights=(1.0, 0.5, 0.5)),
])
def test_packing_places_every_piece(spark, caps):
    rows = helpers.documents()
    got = packing.pack_documents(helpers.table(spark, rows), WORD_BPE, caps).collect()
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(plain_pieces(rows, caps.tokens), key=key)
    bins = assert_packed(got, caps)
    if caps.documents > 3 and caps.rule == "residual_norm":
        assert bins <= 1.02 * -(-sum(r.length for r in got) // caps.tokens) + 1


def test_packing_keeps_odd_white_space(spark):
    odd = ["\ue000 a\ue000 b", "a\x1cb", "A B", "x y\u0085z", "é ́a", "it's<|endoftext|>it", "İI", "ΣΣ", " lead", "tail ", "\t\t", "\r\n"]
    rows = list(enumerate(odd))
    got = packing.token_pieces(helpers.table(spark, rows), WORD_BPE).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_pieces(rows, 2048))


def test_best_fit_covers_all_numbers():
    rng = np.random.default_rng(4)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 129, 60), rng.integers(1, 50, 60), strict=True)}
    caps = packing.Capacities(tokens=128, documents=5, attention=9000)
    with pytest.raises(ValueError):
        packing.best_fit({129: 1}, caps)
    counts = {n: c for n, c in counts.items() if n * n <= 9000}
    plan = packing.best_fit(counts, caps)
    for n, c in counts.items():
        mine = sorted((int(r[1]), int(r[2])) for r in plan if r[0] == n)
        assert sum(k for _, k in mine) == c and [a for a, _ in mine] == list(np.cumsum([0, *(k for _, k in mine)])[:-1])
    left = defaultdict(lambda: [128, 5, 9000])
    for n, _, put, first, _, each in plan:
        for k in range(put):
            b = left[first + k // each]
            b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
    assert all(min(b) >= 0 for b in left.values())


def test_encoder_looks_letters_and_marks_up_apart():
    enc = packing.WordEncoder(WORD_BPE)
    list(enc.encode(["Word word, word. word; WORD!\nword,", "", "other other."]))
    assert len(enc.young) == 1 + 2 + 4


def test_encoder_equals_the_whole_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CHARS", 300)
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    rng = random.Random(3)
    bits = ["a", "It", "don't", "!", ",", ".,", "&&&", "#x", "x#", "a,b", "a,b,", "é", "É", "ßö", "÷", "a÷", "ÿ.", "e\u0301", "\u00a0", "\t", "\r", "\x00", "日本",
            "12", "3.5", "%", "(x)", "<|endoftext|>", "ﬁ", "\u2028", "😀", "word", "words", " ", "  ", "\n", "\n\n", "A\u030a", "Ωmega;", "naïve?", "'", "it's,"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "\n"] * 2
    whole = Tokenizer.from_file(WORD_BPE)
    got = list(packing.WordEncoder(WORD_BPE).encode(texts))
    assert got == [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]


def resident_mb():
    with open("/proc/self/statm", encoding="ascii") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_many_tasks_of_a_worker_leave_no_memory(monkeypatch):
    """A worker has an encoder for each task; what one leaves behind would grow with the number of tasks."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(20_000)) for _ in range(3)]
    after = []
    for _ in range(12):
        enc = packing.WordEncoder(WORD_BPE)
        assert enc.young == {" ": b""} and not enc.old
        assert len(list(enc.encode(texts))) == 3
        del enc
        common.memory_returned()
        after.append(resident_mb())
    assert after[-1] - after[3] < 12, after


def test_encoder_follows_a_changed_vocabulary(tmp_path):
    path = tmp_path / "words.json"
    shutil.copy(WORD_BPE, path)
    before = list(packing.WordEncoder(str(path)).encode(["some words"]))
    spec = json.loads(path.read_text(encoding="utf-8"))
    spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path.write_text(json.dumps(spec), encoding="utf-8")
    whole = Tokenizer.from_file(str(path))
    assert packing.WordEncoder(str(path)).whole.encode("Some Words").ids == whole.encode("Some Words").ids
    assert before == list(packing.WordEncoder(WORD_BPE).encode(["some words"]))


def test_packing_chains_no_python_steps(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df)

    monkeypatch.setattr(packing, "stored", seen)
    packing.pack_documents(helpers.table(spark, helpers.documents()), WORD_BPE).collect()
    assert plans and max(p.count("MapInArrow") for p in plans) == 1


def test_packing_empty_table(spark):
    assert packing.pack_documents(helpers.table(spark, []).limit(0), WORD_BPE).count() == 0


# ---- components ----


@pytest.mark.parametrize("links_of_a_task", [250_000, 60])
def test_components_of_chains_stars_and_repeats(spark, monkeypatch, links_of_a_task):
    monkeypatch.setattr(components, "TASK_LINKS", links_of_a_task)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (7, 6), (6, 7), (2000, 1999)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)).collect()}
    nodes = {x for p in links for x in p}
    assert got == helpers.components(nodes, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- line dedup ----


def plain_lines(rows, min_chars=40, min_docs=5):
    blanks, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(low)
    held = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= min_chars:
                held[key(x)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(held.get(key(x), ())) >= min_docs and doc < max(held[key(x)]) for x in lines]
        kept = [x for x, g in zip(lines, gone, strict=True) if not g]
        out.append((doc, "\n".join(kept) if any(gone) else text, len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(spark, batches):
    rows = helpers.documents()
    docs = helpers.table(spark, rows)
    got = line_dedup.dedup_lines(docs, batches=batches)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(plain_lines(rows))
    assert line_dedup.dedup_lines(docs.limit(0), batches=batches).count() == 0


# ---- n-gram join ----


def plain_jaccard(rows, n, percent):
    sets = []
    for doc, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append((doc, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}))
    links = []
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                links.append((a, b))
    top = helpers.components({d for d, _ in sets if d is not None}, links)
    return [(d, len(s), top.get(d)) for d, s in sets], links


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(spark, n, percent):
    rows = [r for r in helpers.documents() if r[0] != 405 or len(r[1]) > 1000]
    want, links = plain_jaccard(rows, n, percent)
    assert len(links) > 20
    got = ngram_join.jaccard_components(helpers.table(spark, rows), ngram_join.JaccardJoin(words=n, percent=percent))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(want)


def test_near_copies_that_no_leader_links(spark):
    """A chain of copies, each like its neighbours only: pairs beside the leaders must be found too."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(14):
        words = list(words)
        words[(7 * k) % 60] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(50, " ".join(reversed(words))), (51, "w0 w1"), (52, "W0\tw1")]
    want, _ = plain_jaccard(rows, 3, 90)
    assert len({c for _, _, c in want}) < len(rows)
    got = ngram_join.jaccard_components(helpers.table(spark, rows), ngram_join.JaccardJoin(words=3, percent=90))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(want)


def test_ids_with_several_texts_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "Q r s t u v"), (3, "A b c d e f"), (4, None), (None, "a b c d e f")]
    want, _ = plain_jaccard(rows, 3, 90)
    how = ngram_join.JaccardJoin(words=3, percent=90)
    got = ngram_join.jaccard_components(helpers.table(spark, rows), how)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(want)
    assert ngram_join.jaccard_components(helpers.table(spark, []).limit(0), how).count() == 0
    kept = ngram_join.keep_one(helpers.table(spark, rows), how)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 4, None])


# ---- embeddings ----


def plain_cosine(rows, least):
    def ok(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v, label) else None for _, v, label in rows]
    links, n = [], Counter()
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links.append((rows[i][0], rows[j][0]))
                n[i] += 1
    top = helpers.components({r[0] for r in rows}, links)
    return [(r[0], n[i], top[r[0]], r[0] == top[r[0]]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("how", [embedding_dedup.GridJoin(block=16, leaf=4), embedding_dedup.GridJoin(dims=2), embedding_dedup.GridJoin(cosine=0.5, block=7, leaf=3)])
def test_embedding_links(spark, how):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 12))
    rows = [(k, (centres[k % 9] + rng.normal(size=12) * 0.12 * (k % 4)).astype(np.float32).tolist(), k % 3) for k in range(150)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(300 + k, rows[0][1], 0) for k in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] * 12, 1), (403, [None] * 12, 1), (404, rows[0][1], None), (405, [], 1)]
    rows += [(406, [x * 3 for x in rows[0][1]], 0), (407, [1e30] * 12, 2), (408, [1e-30] * 12, 2), (409, [1.0] * 5, 2), (410, [1.0] * 5, 2), (411, [float("inf")] * 12, 2)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, fit string").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = embedding_dedup.embedding_links(table, how)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == sorted(plain_cosine(rows, how.cosine))
    assert embedding_dedup.embedding_links(table.limit(0), how).count() == 0


# ---- the pipeline ----


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = [r for r in helpers.documents() if r[0] != 405] + [(900, "spam " * 100), (901, "few words only")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t)) for d, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
    plain = [(r.doc_id, r.text) for r in quality.quality_filter(docs).collect()]
    assert {900, 901, 400, 401}.isdisjoint(d for d, _ in plain) and len(plain) > 40
    plain = [(d, t) for d, t, _, _ in plain_lines(plain)]
    found, _ = plain_jaccard(plain, 5, 80)
    plain = [r for r, (d, _, c) in zip(plain, found, strict=True) if d == c]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in now.collect()) == Counter((d, t, len(t)) for d, t in plain)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(plain_pieces(plain, 2048))
    assert_packed(got, packing.Capacities())
