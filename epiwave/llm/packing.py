"""Best-fit packing of tokenised documents by vectors of residual capacities.

A piece takes tokens, one document slot and an attention cost (its length squared) from its sequence. Pieces of one
length are alike, so the packing is decided for counts by length: at most ``tokens`` numbers, however many documents
there are. Pieces then find their places by their number among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from epiwave.llm.common import arrow_rows, memory_returned, stored

#: Words whose ids a worker keeps, in two generations; the older one goes when the younger is full.
KEPT_WORDS = 300_000
#: Texts that are handed to a worker at once.
BATCH_ROWS = 1000
#: Letters of no more than one case that no combining mark is needed for, and marks that may follow them.
LETTERS = "a-zß-öø-ÿ"
#: For a word on each line: its letters, or nothing where it has others.
PLAIN_LINES = re.compile(f"^ ([{LETTERS}]+)$|^.+$", re.MULTILINE)
#: Kinds of bytes: of ``LETTERS`` in UTF-8 (bytes of other letters come with one that is OTHER), marks, the space.
OTHER, LETTER, MARK, SPACE = range(4)
KINDS = np.zeros(256, np.uint8)
KINDS[[*b"abcdefghijklmnopqrstuvwxyz", 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = LETTER
KINDS[[*range(0x21, 0x27), *range(0x2A, 0x30), *b":;?|"]] = MARK
KINDS[ord(" ")] = SPACE
#: Characters of texts whose distinct words are looked up together.
GROUP_CHARS = 1_000_000


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds, and how bins are chosen.

    rule: "residual_norm" takes the bin whose weighted residuals are smallest after the piece is in, "dot_product" the
    one whose weighted residuals agree most with what the piece asks for. weights: of tokens, documents and attention.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "residual_norm"


def folded(text: str) -> str:
    """``text`` with A-Z lower-cased where that changes no token: where neither form has anything to compose."""
    low = text.encode().lower().decode()
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
        return low
    return text


class WordTokenizers:
    """A vocabulary's whole tokenizer, and one for letters alone; both share one model."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)
        for token in self.whole.get_added_tokens_decoder().values():
            (self.letters.add_special_tokens if token.special else self.letters.add_tokens)([token])
        for t in (self.whole, self.letters):
            t.no_truncation()
            t.no_padding()
        suffix = self.letters.model.end_of_word_suffix
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.letters.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.plain = bool(suffix)


@lru_cache(maxsize=2)
def tokenizers_as_of(path: str, changed: int, size: int) -> WordTokenizers:
    return WordTokenizers(path)


def word_tokenizers(path: str) -> WordTokenizers:
    """One for each state of a file and worker: the library's threads keep what they cached for a model when it has gone."""
    now = os.stat(path)
    return tokenizers_as_of(path, now.st_mtime_ns, now.st_size)


class WordEncoder:
    """Ids of texts whose tokens never cross a space or line end; keeps the ids of the words it has met lately.

    The vocabulary lower-cases, and cuts letters from the marks that follow them. So a word of plain letters and marks is
    looked up in two parts. Letters alone need no normalisation and no cutting: many of them go to the tokenizer's
    model as one text, whose tokens with the end-of-word suffix part the result. All other words go through the
    whole tokenizer, one by one.
    """

    def __init__(self, path: str):
        both = word_tokenizers(path)
        self.whole, self.letters, self.ends, self.plain = both.whole, both.letters, both.ends, both.plain
        self.young: dict[str, bytes] = {" ": b""}
        self.old: dict[str, bytes] = {}

    def learn_letters(self, words: list[str]) -> None:
        """Words of ``LETTERS`` only, with the space before them."""
        texts = [words[k : k + 500] for k in range(0, len(words), 500)]
        encoded = self.letters.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False)
        for part, e in zip(texts, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                self.young[w] = raw[start:end]
                start = end

    def learn(self, words: list[str]) -> None:
        """The ids of distinct ``words`` of ``parted`` texts that the younger generation lacks."""
        young, old = self.young, self.old
        new = []
        for w in words:
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = ids
        letters, odd = [], []
        for w, plain in zip(new, PLAIN_LINES.findall("\n".join(new)), strict=True):
            (letters if plain and self.plain else odd).append(w)
        self.learn_letters(letters)
        for w, e in zip(odd, self.whole.encode_batch_fast([w.removeprefix(" ") for w in odd], add_special_tokens=False), strict=True):
            young[w] = np.array(e.ids, "<u4").tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each of the distinct ``words``."""
        if len(self.young) > KEPT_WORDS // 2:
            self.young, self.old = {" ": b""}, self.young
        found = list(map(self.young.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if new:
            self.learn(new)
            learnt = map(self.young.__getitem__, new)
            found = [next(learnt) if ids is None else ids for ids in found]
        return found

    def parted(self, raw: bytes) -> np.ndarray:
        """Where the words of ``raw`` begin, each with the space before it, and the marks after a word of letters."""
        kind = KINDS[np.frombuffer(raw, np.uint8)]
        begins = kind == SPACE
        if self.plain:
            spaces = np.flatnonzero(begins)
            after = kind[1:]
            mixed = np.zeros(len(spaces) + 1, bool)
            odd = np.flatnonzero(kind == OTHER)
            back = np.flatnonzero((kind[:-1] == MARK) & (after == LETTER))
            for places in (odd, back):
                mixed[np.searchsorted(spaces, places)] = True
            marks = np.flatnonzero((kind[:-1] == LETTER) & (after == MARK)) + 1
            begins[marks[~mixed[np.searchsorted(spaces, marks)]]] = True
        return np.flatnonzero(begins).astype(np.int32)

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that are folded and have no line ends: those of their distinct words, put in the words' places."""
        coded = [b" " + t.encode() for t in texts]
        raw = b"".join(coded)
        begins = self.parted(raw)
        offsets = np.append(begins, np.int32(len(raw)))
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        ids = self.ids_of(pc.binary_join(distinct, "\n")[0].as_py().split("\n"))
        which, size = words.indices.to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        many = size[which]
        end = np.cumsum(many)
        out = flat[np.arange(end[-1]) + np.repeat(start[which] - end + many, many)].tobytes()
        last = np.searchsorted(begins, np.cumsum([len(t) for t in coded])) - 1
        begin = 0
        for stop in (4 * end[last]).tolist():
            yield out[begin:stop]
            begin = stop

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new words are learnt for many texts at once."""
        group, size = [], 0
        for k, text in enumerate(texts):
            group.append(folded(text).replace("\n", " "))
            size += len(text)
            if size >= GROUP_CHARS or k + 1 == len(texts):
                yield from self.encode_group(group)
                group, size = [], 0


def token_pieces(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces of at most ``tokens`` ids: id, piece, start, length, ids_crc32.

    A document is its text's ids, then ``end_id``; a null text is empty, so each row has at least one piece. Only longer
    documents are cut. The tokenizer must drop white space, as word vocabularies do. Its words are kept for a task, not longer,
    its tokenizers as long as the worker.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread has caches of its own
        enc = WordEncoder(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for row, raw in enumerate(enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * tokens)):
                    part = raw[at : at + 4 * tokens]
                    doc.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )
        del enc
        memory_returned()

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], caps: Capacities) -> np.ndarray:
    """The places of all pieces, as rows (length, first number, pieces, first bin, offset, pieces in each bin).

    Lengths go from long to short. Bins that are alike form groups; each step picks one group for as many pieces of the
    length as it takes, or opens new bins when no group holds one under every constraint.
    """
    full = np.array([caps.tokens, caps.documents, caps.attention], float)
    weights = np.array(caps.weights)
    left = np.zeros((64, 3))
    first, bins, groups, opened = np.zeros(64, np.int64), np.zeros(64, np.int64), 0, 0
    rows = []

    def group(residual, start, n):
        nonlocal left, first, bins, groups
        if groups == len(first):
            left, first, bins = np.concatenate([left, np.zeros_like(left)]), np.append(first, np.zeros_like(first)), np.append(bins, np.zeros_like(bins))
        left[groups], first[groups], bins[groups] = residual, start, n
        groups += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        rest, number = counts[length], 0
        while rest:
            fits = np.flatnonzero((bins[:groups] > 0) & (left[:groups] >= need).all(axis=1))
            if len(fits):
                after = (left[fits] - need) / full
                if caps.rule == "dot_product":
                    score = -(weights * (left[fits] / full) * (need / full)).sum(axis=1)
                else:
                    score = (weights * after * after).sum(axis=1)
                g = int(fits[np.argmin(score)])
                residual, start, there = left[g].copy(), int(first[g]), int(bins[g])
            else:
                g, residual, start, there = -1, full, opened, 1 << 60
            each = int((residual // need).min())
            n, each = (min(there, rest // each), each) if rest >= each else (1, rest)
            put = n * each
            rows.append((length, number, put, start, caps.tokens - int(residual[0]), each))
            group(residual - each * need, start, n)
            if g < 0:
                opened += n
            else:
                first[g], bins[g] = start + n, there - n
            rest, number = rest - put, number + put
        live = np.flatnonzero((bins[:groups] > 0) & (left[:groups, :2] >= 1).all(axis=1))
        left[: len(live)], first[: len(live)], bins[: len(live)], groups = left[live], first[live], bins[live], len(live)
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, caps: Capacities = Capacities(), length_col="length") -> DataFrame:
    """``pieces`` with sequence_id and offset (long); columns of these names are replaced.

    Lengths are whole numbers from 1 to ``caps.tokens``. Offsets in a sequence are gapless from 0. Ties are broken by
    place in the stored table; repeated rows are pieces of their own; an empty table stays empty.
    """
    others = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kept = pieces.select(*others)
    place = len(others)

    def number(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            nth = []
            for x in batch.column(others.index(length_col)).to_pylist():
                k = seen[x] = seen.get(x, -1) + 1
                nth.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=[*others, "__part", "__nth"])

    schema = T.StructType([*kept.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__nth", T.LongType())])
    # Pieces are stored before they are numbered: chained Python steps would keep two workers for each core at once.
    with arrow_rows(pieces.sparkSession, BATCH_ROWS):
        numbered = stored(stored(kept).mapInArrow(number, schema))
    by_part = numbered.groupBy("__part", length_col).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("__part", length_col, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    counts = {int(r[0]): int(r[1]) for r in numbered.groupBy(length_col).count().collect()}  # at most caps.tokens rows
    plan = best_fit(counts, caps)
    keys = plan[:, 0] << 42 | plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]
    ranked = numbered.join(starts, ["__part", length_col]).withColumn("__rank", F.col("__start") + F.col("__nth")).select(*others, "__rank")

    def seat(batches):
        for batch in batches:
            length = batch.column(others.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(place).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(keys, length << 42 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:place], pa.array(row[:, 3] + nth // row[:, 5]), pa.array(row[:, 4] + nth % row[:, 5] * length)], names=[*others, "sequence_id", "offset"]
            )

    placed = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    return ranked.mapInArrow(seat, T.StructType([*kept.schema.fields, *placed]))


def pack_documents(docs: DataFrame, path: str, caps: Capacities = Capacities(), end_id: int = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """Tokenises, cuts and packs: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, caps.tokens, end_id, id_col, text_col), caps)
