"""Operators that judge texts one by one."""

import hashlib
import json
import random
import re
import struct
from pathlib import Path

import public_tokenizers
import pytest
import zstandard
from tests.llm import helpers
from tokenizers import Tokenizer

from epiwave.llm import bpe, license_scan, quality

TEXTS = Path(__file__).parent / "real_texts"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def repeated_plain(words, n):
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    inside = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= set(range(k, k + n))
    return len(inside)


def test_quality_against_plain_rules(spark):
    rows = helpers.documents() + [(500, "a b c d e f g h i j " * 8), (501, "x# y$ | <z>\n" * 3), (502, "word " * 400)]
    got = {}
    for r in quality.quality_table(helpers.table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    rules = quality.CompressionBands()
    for doc, text in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        repeat = repeated_plain(words, 8)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        raw = t.encode()
        zip_ = zstandard.ZstdCompressor(level=rules.level).compress
        low, high = next((a, b) for m, a, b in rules.bands if len(raw) < m)
        parts = [raw[k : k + 2048] for k in range(0, len(raw) // 2048 * 2048, 2048)]
        bad = [p for p in parts if not rules.chunk_band[0] <= len(p) / len(zip_(p)) <= rules.chunk_band[1]]
        kept = not failed and low <= len(raw) / len(zip_(raw)) <= high and len(bad) * 2 <= len(parts)
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed, kept)
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got[doc]], (doc, t[:60])


def test_bands_reject_repetition_and_noise():
    rng = random.Random(1)
    check = lambda t: quality.assess(t, quality.CompressionBands(), zstandard.ZstdCompressor(level=3).compress)
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) + chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(600))
    assert check(noise)[-2] == "incompressible"
    varied = "".join(f"row {k % 7} of the list says {k % 3} and {k % 11} then stops. " for k in range(400))
    assert check(varied)[-1] is False
    assert check(helpers.prose(rng, 400))[-1] is True


def test_real_prose_of_all_lengths_is_kept():
    """Formal prose is kept whole, cut short, unindented and many texts long; copies of a passage are not."""
    texts = [(TEXTS / name).read_text() for name in ("apache-2.0.txt", "mpl-2.0.txt")]
    check = lambda t: quality.assess(t, quality.CompressionBands(), zstandard.ZstdCompressor(level=3).compress)
    for text in (*texts, *("\n".join(x.strip() for x in t.split("\n")) for t in texts), "\n".join(texts)):
        for size in (400, 900, 1800, 3600, 7200, 12_000, 1 << 20):
            got = check(text[:size])
            assert got[-1] is True, (text[:40], size, got)
    highs = [hi for _, _, hi in quality.CompressionBands().bands]
    assert highs == sorted(set(highs))
    # Words change, so the base rule passes, but most of the text is one passage again and again.
    for n in (30, 300, 3000):
        varied = "".join(f"part {k} of the list says {k} no more than part {k + 1} and stops. " for k in range(n))
        got = check(varied)
        assert not got[5] and got[-2] in ("repetitive", "chunks"), got


def test_empty_table(spark):
    none = helpers.table(spark, []).limit(0)
    assert quality.quality_table(none).count() == 0
    assert license_scan.scan_table(none).count() == 0
    assert bpe.encode_table(none, BYTE_BPE).count() == 0


def test_encoding_equals_the_library(spark):
    rng = random.Random(2)
    odd = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "é", "日本", "123", "٣", "²", "'s", "'", "ll", "…", "<|endoftext|>", "​", "é", "😀", "\r\n", "$%"]
    rows = helpers.documents() + [(1000 + k, "".join(rng.choices(odd, k=rng.randint(0, 20)))) for k in range(400)]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_table(helpers.table(spark, rows), BYTE_BPE, digests=True).collect())
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((doc is not None, doc or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_small_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 40)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    enc = bpe.Encoder(bpe.encoder(BYTE_BPE).vocab)
    texts = [t or "" for _, t in helpers.documents()]
    for text, raw in zip(texts, enc.encode(texts), strict=True):
        assert list(memoryview(raw).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_learnt_once_and_pairs_decided_by_rank(monkeypatch):
    """Marks, digits and line ends are apart from the words beside them, and pairs of tokens need no run of all merges."""
    rng = random.Random(3)
    words, marks = [f" {a}{b}é" for a in helpers.SYLLABLES[:8] for b in helpers.SYLLABLES[:8]], [",", ".", "!?", ";", "7", "12", "\n"]
    text = "".join(w + m for m in marks for w in rng.sample(words, len(words)))
    want = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    enc = bpe.Encoder(bpe.Vocabulary(BYTE_BPE))
    monkeypatch.setattr(bpe.Vocabulary, "merged", None)
    assert [list(memoryview(raw).cast("I")) for raw in enc.encode([text, text[:0], text])] == [want, [], want]
    assert len(enc.known) <= 1 + len(words) + len(marks)


def test_cuts_and_levels_change_nothing(monkeypatch):
    """Parts meet as the library's words do, whatever stands beside them; long words go on where the levels end."""
    rng = random.Random(4)
    odd = ["ab", "the", " ", " ", "  ", "\n", "\n", "\t", "'", "'s", "'ll", ",", "!", "12", "é", "×", "÷", "ÿ", "\xa0", "\x85", "\u2003", "д", "日本", "٣", "²", "ª", "…", "\x00", "́", "<|endoftext|>", "<|end"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 12))) for _ in range(4000)] + ["a" * 700, "ACGT" * 300 + "x", "日本語" * 200, " " * 300, "=" * 900 + "a"]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for levels, chars in ((200, 3_000_000), (2, 100)):
        monkeypatch.setattr(bpe, "LEVELS", levels)
        monkeypatch.setattr(bpe, "GROUP_CHARS", chars)
        monkeypatch.setattr(bpe, "KEPT_PAIRS", chars)
        got = bpe.Encoder(bpe.encoder(BYTE_BPE).vocab).encode(texts)
        assert [list(memoryview(raw).cast("I")) for raw in got] == want


def test_pairs_stay_apart_as_merges_say():
    vocab, rng = bpe.encoder(BYTE_BPE).vocab, random.Random(5)
    tokens = list(vocab.id_of)
    for _ in range(3000):
        word = b"".join(rng.choices(tokens, k=2))
        k = rng.randint(1, len(word) - 1)
        a, b = (vocab.id_of.get(x) for x in (word[:k], word[k:]))
        if a is not None and b is not None:
            assert vocab.stay_apart(a, b) == (vocab.merged(word) == [a, b]), word


def test_tokens_made_in_two_ways(tmp_path):
    """Where ranks can't say how a token was made, the merges themselves decide."""
    spec = json.loads(Path(BYTE_BPE).read_text(encoding="utf-8"))
    letters = list(bpe.byte_alphabet())
    spec["model"]["vocab"] = {t: k for k, t in enumerate([*letters, "ab", "bc", "abc", "ca", "cab"])}
    spec["model"]["merges"] = [["b", "c"], ["a", "b"], ["a", "bc"], ["c", "a"], ["ab", "c"], ["c", "ab"]]
    spec["added_tokens"] = []
    path = tmp_path / "two_ways.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    vocab, tokenizer, rng = bpe.Vocabulary(str(path)), Tokenizer.from_file(str(path)), random.Random(6)
    assert not vocab.ordered
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)]
    assert [list(memoryview(raw).cast("I")) for raw in bpe.Encoder(vocab).encode(texts)] == [tokenizer.encode(t).ids for t in texts]


def test_decode_replaces_broken_bytes():
    vocab = bpe.encoder(BYTE_BPE).vocab
    part = vocab.id_of["é".encode()[:1]]
    assert bpe.decode(struct.pack("<I", part), vocab.bytes_of) == Tokenizer.from_file(BYTE_BPE).decode([part], skip_special_tokens=False)


def test_licences_base_places_and_templates(spark):
    texts = {
        1: "Released under the MIT License.", 2: "released under terms of the mit license", 3: "We ship CC-BY, cc by and CC BY 4.0; All Rights\nReserved",
        4: "Licensed under the Apache License, Version 2.0.", 5: "Licensed under the Apache Software License, Version 2.0.",
        6: "distributed under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3",
        7: None, 8: "", 9: "Copyright 2020 by some people. All rights reserved.", 10: "mit license " * 3, 11: "Licensed under CC BY-NC 4.0",
    }
    got = {r.doc_id: r for r in license_scan.scan_table(helpers.table(spark, list(texts.items()))).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[1].spans[0].first == 0
    assert got[2].labels == "" and 0 < got[2].score < 1  # "the" before "terms" is mandatory
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 2, 11, "cc-by,reserved")
    assert got[4].labels == "apache-2.0" and got[5].labels == ""
    assert got[6].labels == "gpl,gpl-3.0" and got[6].base_labels == "gpl"
    assert got[7].n_words == got[8].n_words == 0 and got[7].labels == "" and got[7].first_word is None and got[7].score == 0.0
    assert got[9].labels == "copyright,reserved" and got[10].labels == "" and got[11].labels == "cc-by,cc-by-nc"


def test_markup_regions():
    m = license_scan.compiled("t", "start [one [two]] {x|y z} {1,2} end")
    accepted = lambda s: bool(m.scan(w := s.encode().split(), range(len(w)))[0])
    for good in ("start x any end", "start one y z any any end", "start one two x q end", "noise start x a b end more"):
        assert accepted(good), good
    for bad in ("start two x a end", "start x end", "start x a b c end", "start y a end", "start x a"):
        assert not accepted(bad), bad


def plain_pattern(wording: str) -> str:
    """The markup as a regular expression over words that each end with a space."""
    out = []
    for token in re.findall(r"\{\d+,\d+\}|[\[\]{}|]|[^\s\[\]{}|]+", wording):
        if re.fullmatch(r"\{\d+,\d+\}", token):
            out.append(rf"(?:\S+ ){token}")
        else:
            out.append({"[": "(?:", "]": ")?", "{": "(?:", "}": ")", "|": "|"}.get(token, re.escape(token) + " "))
    return "".join(out)


def plain_labels(text: str | None) -> set[str]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " " + "".join(w + " " for w in words)
    found = {label for label, wording in license_scan.TEMPLATES if re.search("(?<= )" + plain_pattern(wording), joined)}
    return found | {label for phrase, label in license_scan.PHRASES if f" {phrase} " in joined}


def licence_texts() -> list[str]:
    """Wordings that templates take, damaged in places, inside prose."""
    rng = random.Random(9)

    def filled(wording: str) -> str:
        while m := re.search(r"\{(\d+),(\d+)\}|\[([^\[\]{}]*)\]|\{([^\[\]{}]*)\}", wording):
            if m[1]:
                part = " ".join(rng.choices(["alpha", "beta", "the"], k=rng.randint(int(m[1]), int(m[2]))))
            else:
                part = rng.choice([m[3], ""]) if m[3] is not None else rng.choice(m[4].split("|"))
            wording = wording[: m.start()] + part + wording[m.end() :]
        return " ".join(wording.split())

    out = []
    for _, wording in license_scan.TEMPLATES:
        for damage in range(6):
            words = filled(wording).split()
            if damage % 2:
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["other"], [words[k], words[k]], [words[k].upper() + ","]])
            out.append(f"{helpers.prose(rng, 5)} {' '.join(words)}. {helpers.prose(rng, 5)}")
    return out


def test_licences_equal_a_plain_matcher(spark):
    real = [p.read_text() for p in sorted(TEXTS.glob("*.txt"))]
    texts = [t for _, t in helpers.documents()] + licence_texts() + real + ["permission " * 20_000 + real[0], "licensed under the " * 5000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[-4])]
    got = license_scan.scan_table(helpers.table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, text in rows:
        assert set(filter(None, by_id[k].labels.split(","))) == plain_labels(text), (k, (text or "")[:300])
        assert by_id[k].labels == ",".join(sorted(plain_labels(text)))
    assert license_scan.scan_table(helpers.table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("text, labels", [
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-NonCommercial License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Mozilla Public License, v. 1.1", ""),
    ("under the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl,gpl-2.0"),
    ("Apache License Version 2.0, January 2004", "apache-2.0"),
    ("Apache License Version 1.1", ""),
    ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
    ("the MIT license is short", ""),
    ("BSD tools are licensed differently", ""),
    ("copyright law knows all rights", ""),
])
def test_labels_of_wordings_and_near_misses(text, labels):
    _, beginning = license_scan.automata(license_scan.TEMPLATES)
    assert license_scan.scan_text(text, beginning, license_scan.PHRASES)[5] == labels
    assert ",".join(sorted(plain_labels(text))) == labels


def test_score_is_the_share_of_mandatory_words():
    _, beginning = license_scan.automata(license_scan.TEMPLATES)
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    machine = next(m for m in license_scan.automata(license_scan.TEMPLATES)[0] if m.label == "mit")
    assert machine.label == "mit"
    short = license_scan.compiled(*license_scan.TEMPLATES[1])
    assert license_scan.scan_text(notice, beginning, license_scan.PHRASES)[6] == pytest.approx(len(notice.split()) / len(short.needed))
    assert license_scan.scan_text("nothing of it", beginning, license_scan.PHRASES)[6] == 0.0
