"""Quality rules by compression bands (operator 12).

Repetitive text compresses far better than prose of its length, encoded or random bytes far worse.
Each text is compressed whole and in chunks of ``CHUNK`` bytes with zstandard, and each ratio
(compressed bytes to bytes) is held against the band of its own length: short texts compress badly
because of the frame and of the little that can repeat, so ``BANDS`` gives limits by length. A text
goes if its whole ratio lies outside the band, or if the chunks outside theirs hold more than
``BAD_SHARE`` of its bytes. The last chunk is judged by its own length, too; one of less than the
first band's length has no verdict.

Base rules come first: fewer than ``MIN_WORDS`` words, or more than half of the words in three-word
windows that occur twice. Each document is judged alone, in one pass without a shuffle.

Rules for odd rows: a null or empty text has no words and fails the base rules; ratios of an empty
text are null; repeated rows each get a row; other columns are not used; an empty table is fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sightings.llm.common import add_columns

LEVEL = 3
CHUNK = 4096
MIN_WORDS = 50
BAD_SHARE = 0.25

# Texts of fewer bytes than the first figure and at least that of the row before have
# ratios between the other two. Below 128 bytes there is no verdict.
BANDS = [
    (256, 0.45, 1.05),
    (512, 0.38, 0.90),
    (1024, 0.32, 0.82),
    (2048, 0.28, 0.75),
    (4096, 0.25, 0.70),
    (16384, 0.22, 0.68),
    (65536, 0.20, 0.66),
    (1 << 62, 0.15, 0.65),
]
LEAST = 128
_ENDS = [b[0] for b in BANDS]

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    w = np.array([index.setdefault(x, len(index)) for x in words], np.int64)
    pairs, size = w[:-1] * len(index) + w[1:], len(index)
    if size > 1 << 20:  # three numbers would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * size + w[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= twice
    return int(hit.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    if size < LEAST:
        return True
    _, low, high = BANDS[int(np.searchsorted(_ENDS, size, "right"))]
    return low <= ratio <= high


def ratios(raw: bytes, press: zstandard.ZstdCompressor, chunk: int) -> tuple[float | None, float | None]:
    """Ratio of the whole text, and share of its bytes in chunks outside their band."""
    if not raw:
        return None, None
    whole = len(press.compress(raw)) / len(raw)
    if len(raw) <= chunk:
        return whole, float(not in_band(len(raw), whole))
    bad = 0
    for i in range(0, len(raw), chunk):
        part = raw[i:i + chunk]
        if not in_band(len(part), len(press.compress(part)) / len(part)):
            bad += len(part)
    return whole, bad / len(raw)


def measure(text: str | None, press: zstandard.ZstdCompressor, chunk: int) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n, repeated = len(words), repeated_words(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    whole, share = ratios(raw, press, chunk)
    kept = not failed and in_band(len(raw), whole) and share <= BAD_SHARE
    return n, chars, symbols, duplicate_lines(raw), repeated, failed, kept, whole, share


_FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, ratio double, bad_chunk_share double")
_TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]


def quality_rules(docs: DataFrame, keep: list[str] | None = None, level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` of docs (all, if not given) with counts, ratios and the verdict of each text."""

    def compute(batch: pa.RecordBatch) -> list:
        press = zstandard.ZstdCompressor(level=level)
        rows = [measure(x.as_py(), press, chunk) for x in batch["text"]]
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]

    keep = docs.columns if keep is None else keep
    return add_columns(docs.select(*dict.fromkeys([*keep, "text"])), compute, _FIELDS, keep)


def op12(docs: DataFrame) -> DataFrame:
    return quality_rules(docs, ["doc_id"])
