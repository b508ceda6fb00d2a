"""Benchmark decontamination with an FM-index per training shard (operator 1).

Each task cuts its documents into shards of at most ``SHARD_SYMBOLS`` words (a longer document is a
shard of its own). A shard's words become numbers, its suffix array is sorted, and the index is what
an FM-index holds: the Burrows-Wheeler transform in a wavelet matrix, the symbol counts, and the
suffix positions that are multiples of ``SAMPLE``. All benchmark windows are searched backwards at
once through wavelet ranks; the rows found are located by walking to a sampled position. Located
occurrences merge into removal spans. Documents are scanned once and never shuffled.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, by broadcast; more
blocks are chained as further passes over the same rows, each adding its spans and items, so the
result is the same for any number of blocks.

A word is a maximal run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is
``n`` consecutive words of an item, or all of a shorter item. Words compare by a 64-bit hash.

Rules for odd rows: a null text has no words and is not contaminated; a benchmark row with a null
id or without words has no windows; ids on several benchmark rows count once; repeated documents
each get a row; an empty documents or benchmark table is fine; other columns pass through unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import add_columns, fresh_names

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many
SHARD_SYMBOLS = 1 << 18
BLOCK_BYTES = 8 << 20
SAMPLE = 8

_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0"):ord("9") + 1] = _IS_WORD[ord("a"):ord("z") + 1] = _IS_WORD[128:] = True
_BYTE_CODE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, text number, first and past-the-last byte (within all texts joined by \\n) of every word."""
    raw = b"\n".join(texts)
    buf = np.frombuffer(raw.lower(), np.uint8)
    word = _IS_WORD[buf]
    if not word.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, raw
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    inside = np.flatnonzero(word)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    power = powers(_STEP, int(length.max()))
    digest = np.add.reduceat(_BYTE_CODE[buf[inside]] * power[place], first)
    digest ^= digest >> np.uint64(29)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return digest, np.searchsorted(np.cumsum(sizes), start, side="right"), start, end, raw


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t (non-negative, its last symbol unique): prefix doubling on tied suffixes."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    k = max(1, min(n, 63 // bits))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[:n - j] |= t[j:]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied):
        pos = sa[tied]
        pair = rank[pos] * (n + 1) + rank[np.minimum(pos + k, n - 1)]
        order = np.argsort(pair, kind="stable")
        pos, pair = pos[order], pair[order]
        sa[tied] = pos
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[pos] = tied[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return sa


class FMIndex:
    """FM-index of a sequence of symbols whose last one occurs once."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(t)
        self.n, self.sample = len(t), sample
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t))])  # rows before each symbol
        cur = t[sa - 1]  # the Burrows-Wheeler transform (row of suffix 0 wraps to the last symbol)
        self.levels = max(1, int(t.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            up = bit.astype(bool)
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            cur = np.concatenate([cur[~up], cur[up]])
        # where each symbol's block begins at the bottom of the wavelet matrix
        self.block = np.zeros(len(self.first), np.int64)
        head = np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]]))
        self.block[cur[head]] = head
        marked = sa % sample == 0
        self.mark = np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
        self.samples = sa[marked]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """first[symbol] + rank(symbol, row)."""
        i = row
        for level in range(self.levels):
            ones = self.ones[level][i]
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return self.first[symbol] + i - self.block[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol to the left."""
        i, symbol = row, np.zeros(len(row), np.int64)
        for level in range(self.levels):
            ones = self.ones[level][i]
            bit = self.ones[level][i + 1] - ones
            symbol = (symbol << 1) | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return self.first[symbol] + i - self.block[symbol]

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns symbols[start : start + length], all at once."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        live = np.arange(len(start))
        for t in range(int(length.max()) if len(length) else 0):
            live = live[(length[live] > t) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = symbols[start[live] + length[live] - 1 - t]
            both = self.step(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[:len(live)], both[len(live):]
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(at):
            done = self.mark[row + 1] > self.mark[row]
            out[at[done]] = self.samples[self.mark[row[done]]] + steps
            at, row = at[~done], self.back(row[~done])
            steps += 1
        return out


def prepare(items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """The distinct windows of a block of (item id, text) and the items of each."""
    words, at, _, _, _ = split_words([t.encode("utf-8", "surrogatepass") for _, t in items])
    count = np.bincount(at, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    start, length, owner, seen = [], [], [], {}
    for i, (n, f) in enumerate(zip(count.tolist(), first.tolist())):
        size = min(window, n)
        for s in range(f, f + n - size + 1) if n else ():
            w = seen.setdefault(words[s:s + size].tobytes(), len(start))
            if w == len(start):
                start.append(s)
                length.append(size)
                owner.append(set())
            owner[w].add(items[i][0])
    return {"words": words, "start": np.array(start, np.int64), "length": np.array(length, np.int64), "owner": [sorted(o) for o in owner]}


def search_shard(texts: list[bytes], block: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]], tuple]:
    """For each text: number of words, hit word ranges (merged, within the text), ids of its items."""
    words, owner, start, end, _ = split_words(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    spots = (owner, start, end)
    if not len(words) or not len(block["start"]):
        return n_words, ranges, items, spots
    kinds, symbol = np.unique(words, return_inverse=True)
    wanted = np.searchsorted(kinds, block["words"])
    known = kinds[np.minimum(wanted, len(kinds) - 1)] == block["words"]
    missing = np.concatenate([[0], np.cumsum(~known)])
    w = np.flatnonzero(missing[block["start"] + block["length"]] == missing[block["start"]])
    if not len(w):
        return n_words, ranges, items, spots
    # symbols: 0 ends the shard, 1.. end a text (each its own, so no match or tie crosses texts), words above
    low = len(texts) + 1
    ends = np.cumsum(n_words)
    t = np.concatenate([np.insert(symbol.astype(np.int64) + low, ends, np.arange(1, low)), [0]])
    index = FMIndex(t)
    lo, hi = index.search(wanted + low, block["start"][w], block["length"][w])
    size = hi - lo
    rows = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    which = np.repeat(w, size)
    spot = index.locate(rows)
    text = np.searchsorted(ends + np.arange(1, low), spot, side="right")
    word = spot - text  # every text before has added one symbol
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, word, 1)
    np.add.at(delta, word + block["length"][which], -1)
    hit = np.cumsum(delta[:-1]) > 0
    # merged spans, cut where a text begins
    opens = hit & (np.concatenate([[True], ~hit[:-1]]) | np.concatenate([[True], owner[1:] != owner[:-1]]))
    closes = hit & (np.concatenate([~hit[1:], [True]]) | np.concatenate([owner[1:] != owner[:-1], [True]]))
    base = ends - n_words
    for s, e in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist()):
        ranges[owner[s]].append((s - int(base[owner[s]]), e + 1 - int(base[owner[s]])))
    pairs = np.unique(text * len(block["start"]) + which)
    for d, k in zip((pairs // len(block["start"])).tolist(), (pairs % len(block["start"])).tolist()):
        items[d].update(block["owner"][k])
    return n_words, ranges, items, spots


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that a batch's texts have at most about ``limit`` words."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        # a word and its gap have two characters at least, five or six as a rule
        sizes = 1 + pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 5
        at = 0
        while at < len(b):
            take = int(np.searchsorted(np.cumsum(sizes[at:]), limit - size, side="right")) or (0 if held else 1)
            if take:
                held.append(b.slice(at, take))
                size += int(sizes[at:at + take].sum())
                at += take
            if at < len(b):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark as broadcasts of prepared blocks, each of at most about ``block_bytes``."""
    spark = benchmark.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    count = max(1, -(-int(total) // block_bytes))
    return [spark.sparkContext.broadcast(prepare([(r.item_id, r.text) for r in items.filter(
        F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()], window)) for k in range(count)]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE,
         shard_symbols: int = SHARD_SYMBOLS, block_bytes: int = BLOCK_BYTES, name: str = "decon") -> DataFrame:
    """All columns of ``docs`` plus the struct ``name`` (n_words, n_hit, items, spans, contaminated).

    spans are the merged removal spans as byte offsets into the UTF-8 text, words the same as word
    numbers, past the last one each. A column of that name is replaced."""
    words_type = "array<struct<first:bigint,past:bigint>>"
    decon = (f"struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:{words_type},words:{words_type},contaminated:boolean>")
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                       ("spans", pairs), ("words", pairs), ("contaminated", pa.bool_())])
    cur = docs.drop(name).withColumn(name, F.lit(None).cast(decon))
    names, schema = cur.columns, cur.schema

    def pass_over(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _shards(batches, shard_symbols):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
                n_words, ranges, items, (owner, start, end) = search_shard(texts, block.value)
                base = np.cumsum([0, *(len(t) + 1 for t in texts)])
                first = np.cumsum(n_words) - n_words
                out = []
                for i, had in enumerate(b[name].to_pylist()):
                    old = [(r["first"], r["past"]) for r in had["words"]] if had else []
                    words = _union(old, ranges[i])
                    n_hit = sum(e - s for s, e in words)
                    spans = [(int(start[first[i] + s] - base[i]), int(end[first[i] + e - 1] - base[i])) for s, e in words]
                    out.append({"n_words": int(n_words[i]), "n_hit": n_hit, "items": sorted(items[i].union(had["items"] if had else ())),
                                "spans": [{"first": s, "past": e} for s, e in spans],
                                "words": [{"first": s, "past": e} for s, e in words],
                                "contaminated": bool(n_hit and share * n_hit >= n_words[i])})
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names[:-1]), pa.array(out, arrow)], names=names)
        return run

    for block in _blocks(benchmark, window, block_bytes):
        cur = cur.mapInArrow(pass_over(block), schema)
    return cur


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns; item ids are sorted as strings."""
    found = mark(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark)
    return found.select(
        "doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("decon.items", ","), 256).alias("items_sha256"), "decon.contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the removal spans cut out of the text; all other columns as they are."""
    name, = fresh_names(docs, "decon")
    found = mark(docs, benchmark, name=name, **options)

    def cut(b: pa.RecordBatch) -> list:
        texts = []
        for t, d in zip(b["text"].to_pylist(), b[name].to_pylist()):
            if t is not None and d["spans"]:
                raw, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
                for s in d["spans"]:
                    kept.append(raw[at:s["first"]])
                    at = s["past"]
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            texts.append(t)
        return [pa.array(texts, pa.string())]

    return add_columns(found, cut, "text string").select(*docs.columns)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns as they are."""
    name, = fresh_names(docs, "decon")
    return mark(docs, benchmark, name=name).filter(~F.col(f"{name}.contaminated")).drop(name)


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
spots AS (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM spots),
places AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) sizes WHERE len(w) >= k),
occ AS (SELECT a.r, a.i, a.k, win.item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) a JOIN win ON win.k = a.k AND win.g = a.g),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM occ) x GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.r = d.r LEFT JOIN ids ON ids.r = d.r
"""
