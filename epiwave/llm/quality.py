"""Quality rules: word statistics, then compression bands.

Every text is compressed with zstandard as a whole and in chunks of fixed size. The ratio raw / compressed is held
against limits that depend on the text's length: a ratio above the band means repetition, one below it noise.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, reason string, kept boolean"
)


@dataclass(frozen=True)
class CompressionBands:
    """Limits of the ratio raw / compressed.

    bands: (bytes below which the row holds, lowest ratio, highest ratio), by rising length. The ratio of ordinary prose
    rises with its length, as the compressor sees more of it, so the limits do too, for each doubling of the length.
    Licences, manuals and help texts, which repeat their terms more than most prose, reach 2.5 at 1 KB, 2.9 at 7 KB and
    3.0 at 16 KB as whole texts and mostly 2.5 in chunks; the highest ratios lie well clear of that.
    """

    bands: tuple[tuple[float, float, float], ...] = (
        (256, 0.7, 2.6),
        (512, 1.0, 3.0),
        (1024, 1.15, 3.2),
        (2048, 1.3, 3.4),
        (4096, 1.4, 3.6),
        (8192, 1.4, 3.9),
        *((1 << k, 1.4, round(4.2 + 0.3 * (k - 14), 1)) for k in range(14, 41)),
        (math.inf, 1.4, 12.3),
    )
    chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (1.3, 3.4)
    #: A document is rejected when more than this share of its chunks lies outside the band.
    bad_chunk_share: float = 0.5
    level: int = 3
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30


def repeated_words(words: list, window: int) -> int:
    """Words inside windows that occur at least twice in ``words``."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, end = 0, 0
    for start, gram in enumerate(grams):
        if counts[gram] > 1:
            total += start + window - max(start, end)
            end = start + window
    return total


def assess(text: str | None, rules: CompressionBands, compress) -> tuple:
    """One row of ``RESULT``. A missing text counts as an empty one."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    ratio = len(raw) / len(compress(raw)) if raw else 1.0
    low, high = next((lo, hi) for below, lo, hi in rules.bands if len(raw) < below)
    least, most = rules.chunk_band
    chunks = [len(c) / len(compress(c)) for c in (
        raw[k : k + rules.chunk_bytes] for k in range(0, len(raw) - rules.chunk_bytes + 1, rules.chunk_bytes)
    )]
    bad = sum(not least <= x <= most for x in chunks)
    if failed:
        reason = "words" if len(words) < rules.min_words else "repeated_words"
    elif ratio > high:
        reason = "repetitive"
    elif ratio < low:
        reason = "incompressible"
    elif bad > rules.bad_chunk_share * len(chunks):
        reason = "chunks"
    else:
        reason = None
    return (
        len(words), sum(len(w.decode()) for w in words) if not raw.isascii() else sum(map(len, words)),
        len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed,
        ratio, len(chunks), bad, reason, reason is None,
    )


def quality(text: Column, rules: CompressionBands = CompressionBands()) -> Column:
    """A struct of ``RESULT`` for each text.

    Null and empty texts have no words and fail the base rule. Texts are judged one by one, so repeated rows, other
    columns and their names play no part; an empty table gives an empty result.
    """
    schema = RESULT

    @F.arrow_udf(schema)
    def judged(texts: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=rules.level).compress
        rows = [assess(t.as_py(), rules, compress) for t in texts]
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        types = [kinds[f.split()[1]] for f in schema.split(", ")]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return judged(text)


def quality_table(docs: DataFrame, rules: CompressionBands = CompressionBands(), id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: its id and the columns of ``RESULT``."""
    return docs.select(F.col(id_col), quality(F.col(text_col), rules).alias("__q")).select(id_col, "__q.*")


def quality_filter(docs: DataFrame, rules: CompressionBands = CompressionBands(), text_col="text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.filter(quality(F.col(text_col), rules)["kept"])
