"""Byte-level BPE encoding over a trie of distinct words, and decoding.

The encoding of a prefix of a word is the encoding of a shorter prefix plus one last token. Distinct words of a batch
are put into a trie of bytes, which is walked level by level: each node gets its last token, found from the last tokens
of its ancestors, so a prefix that many words share is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "n_tokens long, ids binary, decoded string"

#: Fixed value: the pre-tokenisation pattern of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words kept between batches; beyond it the store starts anew, which costs time and changes nothing.
KEPT_WORDS = 1_000_000
#: Pairs of tokens kept between batches, in the same way.
KEPT_PAIRS = 2_000_000
#: Characters of texts whose new words share a trie.
GROUP_CHARS = 3_000_000
#: Levels of the trie; what a word has beyond them is walked for itself.
LEVELS = 200
#: Kinds of bytes: first those that may be white space or begin it, then first bytes of other characters beyond U+007F,
#: then the apostrophe, letters up to U+00FF, digits and other marks.
OTHER, SPACE, BREAK, LEAD, QUOTE, LETTER, DIGIT, MARK = range(8)
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = LEAD
KINDS[0x21:0x7F] = MARK
KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
KINDS[[*b"0123456789"]] = DIGIT
KINDS[[*b" \n'"]] = SPACE, BREAK, QUOTE
#: Whether a word always begins between bytes of the two kinds, as 8 * first + second.
BETWEEN = np.zeros((8, 8), bool)
BETWEEN[QUOTE:, BREAK] = True
BETWEEN[LETTER, [QUOTE, DIGIT, MARK]] = True
BETWEEN[DIGIT, [QUOTE, LETTER, MARK]] = True
BETWEEN[MARK, [LETTER, DIGIT]] = True
BETWEEN = BETWEEN.ravel()
#: A byte that UTF-8 never has stands before texts and special tokens.
EDGE = b"\xff"
#: Parts that are one word.
PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: itself where a byte prints, else the next character from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges as ranked pairs of ids, special tokens as text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        bytes_of = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special}
        bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of = {b: i for i, b in bytes_of.items() if i not in self.special.values()}
        self.bytes_of = np.full(max(bytes_of) + 1, None, object)
        for i, b in bytes_of.items():
            self.bytes_of[i] = b
        self.size_of = np.array([len(b or b"") for b in self.bytes_of], np.int32)
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = r
        special = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # How each token is made: (rank, first token, second token).
        self.made: dict[int | None, tuple[int, int, int]] = {self.id_of.get(bytes_of[a] + bytes_of[b]): (r, a, b) for (a, b), r in self.rank.items()}
        # Whether each token is made in one way only, and after the tokens it is made of.
        self.ordered = None not in self.made and len(self.made) == len(self.rank) and all(x not in self.made or self.made[x][0] < r for r, a, b in self.made.values() for x in (a, b))
        self.fits = Fits(self)
        # Tokens that their own bytes don't encode to can't occur.
        self.suffixes = Suffixes({b: i for b, i in self.id_of.items() if self.merged(b) == [i]}, len(self.bytes_of))

    def merged(self, word: bytes) -> list[int]:
        """The encoding of ``word`` by merges in the order of their ranks."""
        ids = [self.id_of[bytes([b])] for b in word]
        rank, made = self.rank, self.id_of
        while len(ids) > 1:
            best = min(zip(ids, ids[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
            if best not in rank:
                break
            new, out, k = made[self.bytes_of[best[0]] + self.bytes_of[best[1]]], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the two tokens come out again when the merges run over the bytes of both.

        Takes the tokens apart again, the one made last first, and looks whether those that then meet would have merged
        before that. Of merges of one rank the left one comes first.
        """
        if not self.ordered:
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        rank, made, byte = self.rank, self.made, (-1, 0, 0)
        limit = 1 << 60
        while rank.get((a, b), limit) >= limit:
            left, right = made.get(a, byte), made.get(b, byte)
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            elif right[0] >= 0:
                limit, b = right[0] + 1, right[1]
            else:
                return True
        return False


class Fits(dict):
    """Whether tokens a and b stay apart, by a << 20 | b; decided when first asked for."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, key: int) -> bool:
        fit = self[key] = self.vocab.stay_apart(key >> 20, key & 0xFFFFF)
        return fit


class Suffixes:
    """The tokens that a text ends in, longest first: a trie of tokens whose nodes know their longest proper suffix in it."""

    def __init__(self, tokens: dict[bytes, int], ids: int):
        self.child: dict[int, int] = {}
        token_at, above = [-1], [(0, 0)]
        for word, token in tokens.items():
            node = 0
            for b in word:
                step = self.child.get(node << 8 | b)
                if step is None:
                    step = self.child[node << 8 | b] = len(token_at)
                    token_at.append(-1)
                    above.append((node, b))
                node = step
            token_at[node] = token
        depth = [0] * len(above)
        for node in range(1, len(above)):
            depth[node] = depth[above[node][0]] + 1
        self.suffix = [0] * len(above)
        longest = [-1] * len(above)
        shorter = [-1] * ids
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            parent, b = above[node]
            if parent:
                self.suffix[node] = self.next(self.suffix[parent], b)
            longest[node] = longest[self.suffix[node]]
            if token_at[node] >= 0:
                shorter[token_at[node]], longest[node] = longest[node], token_at[node]
        self.keys = np.array(sorted(self.child), np.int64)
        self.nodes = np.array([self.child[k] for k in self.keys.tolist()], np.int64)
        self.suffixes = np.array(self.suffix, np.int64)
        self.longest, self.shorter = np.array(longest, np.int32), np.array(shorter, np.int32)

    def next(self, node: int, byte: int) -> int:
        """The node of the longest suffix of the text after one more byte."""
        while (step := self.child.get(node << 8 | byte)) is None:
            if not node:
                raise KeyError(f"no token for byte {byte}")
            node = self.suffix[node]
        return step

    def next_of(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``next`` for many."""
        out, todo = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        while len(todo):
            key = nodes << 8 | byte[todo]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            out[todo[hit]] = self.nodes[at[hit]]
            if not nodes[~hit].all():
                raise KeyError("no token for a byte")
            todo, nodes = todo[~hit], self.suffixes[nodes[~hit]]
        return out


class WordTrie:
    """A trie of distinct words as bytes; a walk by levels gives each node the last token of its prefix.

    Words are sorted, so those of a node stand side by side and a level is an array.
    """

    def __init__(self, vocab: Vocabulary, words: set[bytes]):
        self.vocab = vocab
        self.words = sorted(words)
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self.size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.cumsum(self.size) - self.size
        #: For each byte of a word, the last token of the prefix that it ends.
        self.last = np.zeros(len(self.bytes), np.int32)

    def walk(self) -> list[tuple[int, int]]:
        """Finds the last tokens; words longer than ``LEVELS``, with the longest suffix of what was walked, come back.

        A node tries the tokens that end there, longest first; just one of them is adjacent to what stands before it.
        """
        v, last = self.vocab, self.last
        words, node, suffix = np.arange(len(self.words)), np.zeros(len(self.words), np.int64), np.zeros(1, np.int64)
        for depth in range(LEVELS):
            longer = self.size[words] > depth
            words, node = words[longer], node[longer]
            if not len(words):
                break
            at = self.start[words] + depth
            byte = self.bytes[at]
            new = np.ones(len(words), bool)
            new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
            first = np.flatnonzero(new)
            suffix = v.suffixes.next_of(suffix[node[first]], byte[first])
            token = v.suffixes.longest[suffix]
            # A token from the word's first byte on stands alone, and a single byte remains where nothing else fits.
            place, size = at[first], v.size_of[token]
            trying = np.flatnonzero((size <= depth) & (size > 1))
            while len(trying):
                tried = token[trying]
                pairs = last[place[trying] - v.size_of[tried]].astype(np.int64) << 20 | tried
                fit = np.fromiter(map(v.fits.__getitem__, pairs.tolist()), bool, len(pairs))
                trying = trying[~fit]
                token[trying] = v.suffixes.shorter[token[trying]]
                trying = trying[v.size_of[token[trying]] > 1]
            node = np.cumsum(new) - 1
            last[at] = token[node]
        longer = self.size[words] > LEVELS
        return list(zip(words[longer].tolist(), suffix[node[longer]].tolist(), strict=True))

    def walk_on(self, word: int, suffix: int) -> bytes:
        """The encoding of a word longer than ``LEVELS``."""
        s, fits = self.vocab.suffixes, self.vocab.fits
        size, longest, shorter = map(memoryview, (self.vocab.size_of, s.longest, s.shorter))
        start = int(self.start[word])
        last = self.last[start : start + LEVELS].tolist()
        for depth, byte in enumerate(self.words[word][LEVELS:], LEVELS):
            suffix = s.next(suffix, byte)
            token = longest[suffix]
            while 1 < size[token] <= depth and not fits[last[depth - size[token]] << 20 | token]:
                token = shorter[token]
            last.append(token)
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= size[ids[-1]]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self) -> dict[bytes, bytes]:
        """The encodings of all words, as little-endian unsigned 32-bit integers."""
        going_on = self.walk()
        words = np.flatnonzero(self.size <= LEVELS)
        at = (self.start + self.size - 1)[words]
        many, found = np.zeros(len(self.words), np.int64), []
        while len(words):
            token = self.last[at]
            found.append((words, token))
            many[words] += 1
            at = at - self.vocab.size_of[token]
            more = at >= self.start[words]
            words, at = words[more], at[more]
        ends = np.cumsum(many)
        flat = np.zeros(int(many.sum()), "<u4")
        for back, (words, token) in enumerate(found, 1):
            flat[ends[words] - back] = token
        raw = flat.tobytes()
        out = {w: raw[a:b] for w, a, b in zip(self.words, (4 * (ends - many)).tolist(), (4 * ends).tolist(), strict=True)}
        return out | {self.words[w]: self.walk_on(w, suffix) for w, suffix in going_on}


def part_begins(raw: np.ndarray) -> np.ndarray:
    """Whether a part begins at a byte of ``raw``; no word crosses parts, and each part alone has the words it has in place.

    Parts begin at a space before what is no white space, at and after a single line end between such, and where letters,
    digits and marks meet. Elsewhere, as at other white space, no part begins, so it stays in a longer one.
    """
    kind = KINDS[raw]
    two = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF are letters, but for two signs
    two = two[(raw[two + 1] != 0x97) & (raw[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = LETTER
    begins = np.zeros(len(raw), bool)
    begins[1:] = BETWEEN[kind[:-1] << 3 | kind[1:]]
    solid = kind >= LEAD
    begins[:-1] |= (kind[:-1] == SPACE) & solid[1:]
    begins[2:] |= (kind[1:-1] == BREAK) & (kind[:-2] >= QUOTE) & solid[2:]
    edge = np.flatnonzero(raw == EDGE[0])
    begins[edge] = True
    begins[edge[edge + 1 < len(raw)] + 1] = True
    return begins


class Encoder:
    """Encodes batches of texts; keeps the encodings of the parts it has seen."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.special = {s.encode(): i.to_bytes(4, "little") for s, i in vocab.special.items()}
        self.known: dict[bytes, bytes] = {EDGE: b""}

    def split(self, text: str) -> list[str]:
        """The text around special tokens, and these; they stand alone, as in the tokenizers library."""
        if self.vocab.special_split is None or not self.vocab.special_split.search(text):
            return [text]
        return [x for x in self.vocab.special_split.split(text) if x]

    def learn(self, parts: list[bytes]) -> None:
        """Puts the words of new parts into one trie and keeps what comes out."""
        if len(self.known) + len(parts) > KEPT_WORDS:
            self.known = {EDGE: b""}
        if len(self.vocab.fits) > KEPT_PAIRS:
            self.vocab.fits.clear()
        plain = {p for p in parts if PLAIN.fullmatch(p)}
        words_of = {p: [w.encode() for w in WORDS.findall(p.decode())] for p in parts if p not in plain and p not in self.special and p != EDGE}
        ids = WordTrie(self.vocab, plain.union(*words_of.values())).encode()
        for p in parts:
            ws = words_of.get(p)
            self.known[p] = self.special.get(p) or (b"".join(map(ids.__getitem__, ws)) if ws else ids.get(p, b""))

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct ``parts``."""
        found = list(map(self.known.get, parts))
        new = [p for p, ids in zip(parts, found, strict=True) if ids is None]
        if not new:
            return found
        # the store may start anew, then all parts are missing
        self.learn(new if len(self.known) + len(new) <= KEPT_WORDS else parts)
        return list(map(self.known.__getitem__, parts))

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of the texts: those of their distinct parts, put in the parts' places."""
        split = [[x.encode() for x in self.split(t)] for t in texts]
        raw = b"".join(EDGE + x for xs in split for x in xs)
        if not raw:
            yield from [b""] * len(texts)
            return
        begins = part_begins(np.frombuffer(raw, np.uint8))
        starts, at = [], 0
        for xs in split:
            starts.append(at)
            for x in xs:
                if x in self.special:
                    begins[at + 2 : at + 1 + len(x)] = False
                at += 1 + len(x)
        begins = np.flatnonzero(begins)
        offsets = np.append(begins, len(raw)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        _, ends, distinct = parts.dictionary.buffers()
        ends, distinct = np.frombuffer(ends, np.int64)[: len(parts.dictionary) + 1].tolist(), distinct.to_pybytes()
        ids = self.ids_of([distinct[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        which, size = parts.indices.to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        many = size[which]
        end = np.cumsum(many)
        out = flat[np.arange(many.sum()) + np.repeat(first[which] - end + many, many)]
        bounds = np.append(0, end)[np.searchsorted(begins, [*starts, at])].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield out[a:b].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, a few million characters at a time."""
        group, size = [], 0
        for k, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size > GROUP_CHARS or k + 1 == len(texts):
                yield from self.encode_group(group)
                group, size = [], 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(Vocabulary(path))


def decode(ids: bytes, bytes_of: np.ndarray) -> str:
    """The text of ids; special tokens stand as they are written, bytes that are no UTF-8 become U+FFFD."""
    return b"".join(bytes_of[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def encoded(text: Column, path: str, digests: bool = False) -> Column:
    """A struct of n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from the ids.

    digests: ids_sha256 and decoded_sha256 instead of ids and decoded, computed in the same task. A null text is an
    empty one and has no tokens. Rows are encoded one by one, so ties and other columns play no part.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        n, ids, out = [], [], []
        for raw in enc.encode([t or "" for t in texts.to_pylist()]):
            text = decode(raw, enc.vocab.bytes_of)
            n.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest() if digests else raw)
            out.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
        names = [f.split()[0] for f in kind.split(", ")]
        types = [pa.int64(), pa.string() if digests else pa.binary(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip((n, ids, out), types, strict=True)], names)

    return run(text)


def encode_table(docs: DataFrame, path: str, digests: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: its id, then the columns of ``encoded``."""
    return docs.select(F.col(id_col), encoded(F.col(text_col), path, digests).alias("__e")).select(id_col, "__e.*")
