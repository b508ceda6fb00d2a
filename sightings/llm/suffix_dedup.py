"""Removing long repeated byte strings with run-length indexes (operator 2).

A byte goes if a ``WIDTH``-byte string that covers it also starts in a document with a smaller
doc_id. All documents count, whole, and strings are judged on the input.

Equal strings have to meet, without gathering the corpus and without sending every string:

1. Documents are packed into chunks of a few MB and written to the shared folder once.
2. A ``WIDTH``-byte string is routed by the smallest hash among its ``K``-byte substrings. Runs of
   neighbouring strings share that hash, so a run is sent as one short segment. First only the
   hashes are sent, 6 bytes each and once a chunk, to find those that occur more than once.
3. Segments of repeated hashes go to their hash's bucket, the bytes of equal ones once a chunk. There
   equal segments collapse to the smallest doc_id that has them; all others of them are repeats from
   end to end. What is left, segments that share a hash but differ somewhere, is indexed.
4. The index of a bucket is a run-length one: the Burrows-Wheeler transform of its segments, cut
   into runs, with the suffix position and the common prefix with the row above sampled at the ends
   of runs. Inside a run both follow from the sample one text position further right (position
   minus one, prefix plus one), so the matching statistics of all positions stream out of the
   samples, right to left. Positions that match their neighbour for ``WIDTH`` bytes are linked to it;
   the smallest doc_id along the links decides who keeps the string.
5. A hash that occurs more than ``HOT`` times, as that of a short phrase in many contexts, isn't
   indexed, as all its segments would meet in one task. Its strings are routed one by one by a hash
   of all their bytes, each once a chunk with its smallest doc_id, so no task gets more than its share.
6. The marks go back to the chunks, which cut the marked bytes.

A passage in a third of all documents sends 16 bytes a string and chunk, however often it occurs there.

Rules for odd rows: a null text is empty and stays null; texts under ``WIDTH`` bytes lose nothing;
rows with the same doc_id aren't repeats of each other; a null doc_id counts as larger than any;
an empty table gives an empty result; other columns pass through unused.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightings.llm.common import scratch_path
from sightings.llm.decontamination import powers, suffix_array

WIDTH = 50
K = 20
CHUNK_BYTES = 4 << 20
HOT = 1 << 13  # occurrences of a routing hash, of which a chunk with 2 to 7 counts as 2
_OFTEN = 8
_BLOCK = 1 << 20
_NULL_ID = np.iinfo(np.int64).max
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def text_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the text column end to end, and where each text begins (and the last ends)."""
    col = pc.fill_null(table["text"].cast(pa.large_binary()), b"")
    arrays = [c for c in col.chunks if len(c)]
    if not arrays:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    arr = pa.concat_arrays(arrays)
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def _route(buf: np.ndarray, width: int, k: int) -> np.ndarray:
    """For each ``width``-byte string of buf the smallest hash of its ``k``-byte substrings, 16 <= k <= 24."""
    v = np.empty(len(buf) - 7, np.uint64)
    for s in range(8):
        v[s::8] = np.frombuffer(buf[s:s + (len(buf) - s) // 8 * 8].tobytes(), "<u8")
    n = len(buf) - k + 1
    h = v[:n] * _C[0] + v[8:8 + n] * _C[1] + v[k - 8:k - 8 + n] * _C[2]
    h ^= h >> np.uint64(29)
    h *= _C[3]
    h ^= h >> np.uint64(32)
    window, size = width - k + 1, 1
    while 2 * size <= window:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (window - size)], h[window - size:])


def runs(buf: np.ndarray, at: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, routing hash) of all runs of strings within the texts."""
    starts, counts, routes = [], [], []
    cover = np.zeros(len(buf) + 1, np.int32)
    long = at[1:] - at[:-1] >= width
    np.add.at(cover, at[:-1][long], 1)
    np.add.at(cover, at[1:][long] - width + 1, -1)
    valid = np.cumsum(cover)[:max(0, len(buf) - width + 1)] > 0
    for lo in range(0, len(valid), _BLOCK):
        ok = valid[lo:lo + _BLOCK]
        if not ok.any():
            continue
        low = _route(buf[lo:lo + len(ok) + width - 1], width, k)
        turn = np.concatenate([[True], (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])])
        first = np.flatnonzero(turn)
        count = np.diff(np.concatenate([first, [len(ok)]]))
        keep = ok[first]
        starts.append(first[keep] + lo)
        counts.append(count[keep])
        g = low[first[keep]] * _C[4]
        g ^= g >> np.uint64(31)
        routes.append(g * _C[0])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(routes)


@lru_cache(maxsize=1)
def _unpowers(n: int) -> np.ndarray:
    return powers(np.uint64(pow(int(_C[0]), -1, 1 << 64)), n)


def string_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width``-byte string of buf, from prefix sums of a polynomial."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << (len(buf) - 1).bit_length()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf + _C[1]) * powers(_C[0], size)[:len(buf)], dtype=np.uint64)])
    h = (total[width:] - total[:-width]) * _unpowers(size)[:n]
    h ^= h >> np.uint64(32)
    h *= _C[3]
    h ^= h >> np.uint64(29)
    return h * _C[2]


def _slices(g: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for sorted hashes, by their top bits."""
    b = (g >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(b)]):
        yield int(b[lo]), lo, hi


def _six(g: np.ndarray, bits: int) -> bytes:
    """The 48 bits below the bucket's."""
    rest = (g << np.uint64(bits)) >> np.uint64(16)
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, first + size), end to end."""
    if not len(size) or not size.sum():
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def matching_statistics(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of t its longest match with the suffix sorted before it (at least ``cap`` if
    it is that long) and where that suffix starts, from samples at the ends of the runs."""
    sa = suffix_array(t)
    n = len(t)
    bwt = t[sa - 1]
    row = np.empty(n, np.int64)
    row[sa] = np.arange(n)
    # a run's first row steps to a text position whose row above can't be told from its right neighbour's
    here = (sa[np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))] - 1) % n
    above = sa[np.maximum(row[here] - 1, 0)]
    # common prefix with the row above, at the samples only
    length = np.zeros(len(here), np.int64)
    live = np.flatnonzero(row[here] > 0)
    while len(live):
        i, j = here[live] + length[live], above[live] + length[live]
        same = (i < n) & (j < n) & (t[np.minimum(i, n - 1)] == t[np.minimum(j, n - 1)])
        live = live[same]
        length[live] += 1
        live = live[length[live] < cap]
    order = np.argsort(here)
    here, above, length = here[order], above[order], length[order]
    # position p takes the sample at or right of it
    gap = np.diff(np.concatenate([[-1], here]))
    back = np.repeat(here, gap) - np.arange(n)
    return np.repeat(length, gap) + back, np.repeat(above, gap) - back


def repeated_strings(raw: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For segments end to end in ``raw``: of each byte, whether the string that starts there fits
    its segment and also starts in a segment with a smaller doc."""
    end = np.cumsum(size)
    first = end - size
    at = np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)  # position in t, one separator a segment
    t = np.ones(len(raw) + len(size) + 1, np.int64)
    t[at] = raw.astype(np.int64) + 2
    t[-1] = 0
    length, above = matching_statistics(t, width)
    fits = np.zeros(len(t), bool)
    fits[at] = np.arange(len(raw)) + width <= np.repeat(end, size)
    owner = np.full(len(t), _NULL_ID)
    owner[at] = np.repeat(doc, size)
    linked = fits & (length >= width)
    parent = np.where(linked, above, np.arange(len(t)))
    spots = np.flatnonzero(linked)
    while True:  # to the top of each chain of equal strings
        up = parent[parent[spots]]
        if np.array_equal(up, parent[spots]):
            break
        parent[spots] = up
    least = owner.copy()
    np.minimum.at(least, parent[spots], owner[spots])
    return (fits & (least[parent] < owner))[at]


def _pack_hashes(rows: Iterator[pa.RecordBatch], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"].to_pylist()):
            buf, at = text_bytes(_unpack(blob))
            _, _, g = runs(buf, at, width)
            u, n = np.unique(g, return_counts=True)
            out = [(chunk, b, hi - lo, _six(u[lo:hi], bits) + np.packbits(n[lo:hi] > 1).tobytes() + _many(n[lo:hi])) for b, lo, hi in _slices(u, bits)]
            yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "bucket", "n", "blob"), o)) for o in out], _HASH_SCHEMA)


def _many(n: np.ndarray) -> bytes:
    """Place and number of those with ``_OFTEN`` or more."""
    at = np.flatnonzero(n >= _OFTEN)
    return np.column_stack([at, n[at]]).astype("<u4").tobytes()


_HASH_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _repeated_hashes(pdf: pd.DataFrame, hot: int = HOT) -> pd.DataFrame:
    """Of each chunk's hashes in a bucket, the bit masks of those that occur more than once and of the hot ones."""
    sizes = pdf["n"].to_numpy()
    values, weight = [], []
    for n, blob in zip(sizes.tolist(), pdf["blob"]):
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
        values.append(raw.reshape(-1).view("<u8"))
        weight.append(1 + np.unpackbits(np.frombuffer(blob, np.uint8, offset=6 * n), count=n).astype(np.int64))
        place, number = np.frombuffer(blob, "<u4", offset=6 * n + -(-n // 8)).reshape(-1, 2).T
        weight[-1][place] = number
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(at, np.concatenate(weight))
    ends = np.cumsum(sizes)

    def masks(found: np.ndarray) -> list:
        return [np.packbits(found[e - n:e]).tobytes() if found[e - n:e].any() else None for n, e in zip(sizes.tolist(), ends.tolist())]

    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "mask": masks((total > 1)[at]),
                         "hot": masks((total > max(hot, 1))[at])}).dropna(subset=["mask"])


def _digests(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the segments end to end in ``body``."""
    first = np.cumsum(size) - size
    place = np.arange(len(body)) - np.repeat(first, size)
    return np.add.reduceat((body.astype(np.uint64) + _C[1]) * powers(_C[0], int(size.max()))[place], first)


def _segments(chunk: pd.DataFrame, masks: pd.DataFrame, bits: int, out_bits: int, width: int) -> pd.DataFrame:
    """A chunk's segments of repeated hashes, packed by bucket. Equal ones of a chunk share their bytes:
    a blob has the number of different segments, where each occurrence stands, in which document and
    whether it is a new segment, and of each new segment length, hash and bytes. Strings of hot hashes
    go to buckets of their own, from 2^out_bits on: a blob has of each different string its hash, its
    smallest doc_id and whether others of the chunk have it."""
    found = []
    if len(chunk) and len(masks):
        table = _unpack(chunk["blob"].iloc[0])
        buf, at = text_bytes(table)
        start, count, g = runs(buf, at, width)
        u, back = np.unique(g, return_inverse=True)
        often, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
        place = {b: (lo, hi) for b, lo, hi in _slices(u, bits)}
        for b, mask, heat in zip(masks["bucket"].tolist(), masks["mask"], masks["hot"]):
            lo, hi = place[b]
            often[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
            if heat is not None:
                hot[lo:hi] = np.unpackbits(np.frombuffer(heat, np.uint8), count=hi - lo).astype(bool)
        ids = pc.fill_null(table["doc_id"].cast(pa.int64()), _NULL_ID).to_numpy()
        packer = zstandard.ZstdCompressor(level=3)
        if hot.any():
            pick = np.flatnonzero(hot[back])
            string = _ranges(start[pick], count[pick])
            h, doc = string_hashes(buf, width)[string], ids[np.searchsorted(at[1:], string, side="right")]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            final = np.concatenate([first[1:], [len(h)]]) - 1
            h, least, more = h[first], doc[first], doc[final] > doc[first]
            for b, lo, hi in _slices(h, out_bits):
                body = h[lo:hi].astype("<u8").tobytes() + least[lo:hi].astype("<i8").tobytes() + np.packbits(more[lo:hi]).tobytes()
                found.append((int(chunk["chunk"].iloc[0]), (1 << out_bits) + b, hi - lo, packer.compress(body)))
        pick = np.flatnonzero((often & ~hot)[back])
        start, count, g = start[pick], count[pick], g[pick]
        same = np.zeros(len(pick), np.uint64)
        step = max(1, (8 << 20) // (4 * width))
        for lo in range(0, len(pick), step):
            size = count[lo:lo + step] + width - 1
            same[lo:lo + step] = _digests(buf[_ranges(start[lo:lo + step], size)], size)
        order = np.lexsort((start, same, g))
        start, count, g, same = start[order], count[order], g[order], same[order]
        doc = ids[np.searchsorted(at[1:], start, side="right")]
        for b, lo, hi in _slices(g, out_bits):
            new = np.concatenate([[True], (same[lo + 1:hi] != same[lo:hi - 1]) | (g[lo + 1:hi] != g[lo:hi - 1])])
            reps = lo + np.flatnonzero(new)
            body = buf[_ranges(start[reps], count[reps] + width - 1)].tobytes()
            head = (np.array([len(reps)], "<i8").tobytes() + start[lo:hi].astype("<i4").tobytes() + doc[lo:hi].astype("<i8").tobytes()
                    + np.packbits(new).tobytes() + count[reps].astype("<i4").tobytes() + (g[reps] >> np.uint64(16)).astype("<u4").tobytes())
            found.append((int(chunk["chunk"].iloc[0]), b, hi - lo, packer.compress(head + body)))
    return pd.DataFrame(found, columns=["chunk", "bucket", "n", "blob"])


def _hot_marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each chunk's hot strings in a bucket, hash and smallest doc_id of those that a larger one has."""
    unzip, sizes = zstandard.ZstdDecompressor(), pdf["n"].tolist()
    raws = [unzip.decompress(blob) for blob in pdf["blob"]]
    h = np.concatenate([np.frombuffer(r, "<u8", n) for r, n in zip(raws, sizes)])
    doc = np.concatenate([np.frombuffer(r, "<i8", n, 8 * n) for r, n in zip(raws, sizes)])
    more = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8, offset=16 * n), count=n) for r, n in zip(raws, sizes)]) > 0
    u, at = np.unique(h, return_inverse=True)
    least = np.full(len(u), _NULL_ID)
    np.minimum.at(least, at, doc)
    hit, out, end = more | (least[at] < doc), [], 0
    for chunk, n in zip(pdf["chunk"].tolist(), sizes):
        pick = end + np.flatnonzero(hit[end:end + n])
        end += n
        if len(pick):
            out.append((chunk, None, h[pick].astype("<u8").tobytes() + least[at[pick]].astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "marks", "strings"])


def _marks(pdf: pd.DataFrame, out_bits: int, width: int) -> pd.DataFrame:
    """The repeated strings of a bucket's segments, as (first, number) pairs by chunk."""
    if pdf["bucket"].iloc[0] >= 1 << out_bits:
        return _hot_marks(pdf)
    starts, docs, stands_for, counts, routes, bodies, sizes = [], [], [], [], [], [], pdf["n"].to_numpy()
    unzip, reps = zstandard.ZstdDecompressor(), 0
    for n, blob in zip(sizes.tolist(), pdf["blob"]):
        raw = unzip.decompress(blob)
        m, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
        for out, kind, k in ((starts, "<i4", n), (docs, "<i8", n)):
            out.append(np.frombuffer(raw, kind, k, at).astype(np.int64))
            at += k * np.dtype(kind).itemsize
        new = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n)
        stands_for.append(reps + np.cumsum(new, dtype=np.int64) - 1)
        at += -(-n // 8)
        for out, kind in ((counts, "<i4"), (routes, "<u4")):
            out.append(np.frombuffer(raw, kind, m, at).astype(np.int64))
            at += m * np.dtype(kind).itemsize
        bodies.append(np.frombuffer(raw, np.uint8, offset=at))
        reps += m
    start, doc, stands_for, count, route, body = (np.concatenate(x) for x in (starts, docs, stands_for, counts, routes, bodies))
    chunk = np.repeat(pdf["chunk"].to_numpy(), sizes)
    size = count + width - 1
    first = np.cumsum(size) - size
    # equal segments: one stands for all of them
    _, stands, same = np.unique(_digests(body, size), return_index=True, return_inverse=True)
    same, count = same[stands_for], count[stands_for]
    least = np.full(len(stands), _NULL_ID)
    np.minimum.at(least, same, doc)
    # those that share their hash with a different segment are indexed
    _, shared, often = np.unique(route[stands], return_inverse=True, return_counts=True)
    pick = np.flatnonzero(often[shared] > 1)
    picked_first, picked_size = first[stands[pick]], size[stands[pick]]
    hit = repeated_strings(body[_ranges(picked_first, picked_size)], picked_size, least[pick], width) if len(pick) else np.zeros(0, bool)
    hit_first = np.full(len(stands), -1)
    hit_first[pick] = np.cumsum(picked_size) - picked_size
    whole = doc > least[same]
    part = np.flatnonzero(~whole & (hit_first[same] >= 0))
    at = _ranges(hit_first[same[part]], count[part])
    string = _ranges(start[part], count[part])[hit[at]]
    owner = np.repeat(chunk[part], count[part])[hit[at]]
    turn = np.flatnonzero(np.concatenate([[True], (np.diff(string) != 1) | (owner[1:] != owner[:-1])])) if len(string) else np.zeros(0, np.int64)
    marks = pd.DataFrame({"chunk": np.concatenate([chunk[whole], owner[turn]]), "first": np.concatenate([start[whole], string[turn]]),
                          "number": np.concatenate([count[whole], np.diff(np.concatenate([turn, [len(string)]]))])})
    rows = [(int(c), np.column_stack([m["first"], m["number"]]).astype("<i8").tobytes(), None) for c, m in marks.groupby("chunk")]
    return pd.DataFrame(rows, columns=["chunk", "marks", "strings"])


def _hot_strings(table: pa.Table, buf: np.ndarray, at: np.ndarray, strings: list[bytes], width: int) -> np.ndarray:
    """Where the strings start that are repeats by (hash, smallest doc_id) of ``strings``."""
    h = np.concatenate([np.frombuffer(b, "<u8", len(b) // 16) for b in strings])
    least = np.concatenate([np.frombuffer(b, "<i8", offset=len(b) // 2) for b in strings])
    order = np.argsort(h)
    h, least = h[order], least[order]
    own = string_hashes(buf, width)
    maybe = np.zeros(1 << 20, bool)
    maybe[(h >> np.uint64(44)).astype(np.int64)] = True
    spot = np.flatnonzero(maybe[(own >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(h, own[spot]), len(h) - 1)
    row = np.searchsorted(at[1:], spot, side="right")
    ids = pc.fill_null(table["doc_id"].cast(pa.int64()), _NULL_ID).to_numpy()
    return spot[(h[place] == own[spot]) & (spot + width <= at[row + 1]) & (least[place] < ids[row])]


def _cut(chunk: pd.DataFrame, marks: pd.DataFrame, width: int) -> tuple[pa.Table, pd.DataFrame]:
    table = _unpack(chunk["blob"].iloc[0])
    buf, at = text_bytes(table)
    delta = np.zeros(len(buf) + 1, np.int32)
    strings = [b for b in marks["strings"] if b is not None]
    if strings:
        spot = _hot_strings(table, buf, at, strings, width)
        delta[spot] += 1
        delta[spot + width] -= 1
    for blob in marks["marks"]:
        if blob is None:
            continue
        first, number = np.frombuffer(blob, "<i8").reshape(-1, 2).T
        np.add.at(delta, first, 1)
        np.add.at(delta, first + number + width - 1, -1)
    gone = np.cumsum(delta[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    edge[begins] = gone[begins]
    spans = np.concatenate([[0], np.cumsum(edge)])
    kept = buf[~gone]
    left = at - removed[at]
    out = pd.DataFrame({"n_bytes": np.diff(at), "n_removed": np.diff(removed[at]), "n_spans": np.diff(spans[at]),
                        "kept": [kept[a:b].tobytes() for a, b in zip(left[:-1].tolist(), left[1:].tolist())]})
    return table, out


def dedup(docs: DataFrame, schema: StructType | str, finish, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES,
          hot: int = HOT) -> DataFrame:
    """Apply the operator to ``docs`` (doc_id bigint, text and any others).

    finish(table, result) makes the rows of ``schema`` from a chunk's rows as an Arrow table and a
    frame of n_bytes, n_removed, n_spans and kept (bytes) with one row for each."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            blob = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pylist([{"chunk": random.SystemRandom().getrandbits(62), "size": size, "blob": blob}],
                                              pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(batch):
                room = int(np.searchsorted(np.cumsum(lengths[at:]), chunk_bytes - size, side="right")) or (0 if held else 1)
                if room:
                    held.append(batch.slice(at, room))
                    size += int(lengths[at:at + room].sum())
                    at += room
                if at < len(batch):
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    path = scratch_path(spark, "suffix-chunks")
    kind = "chunk bigint, size bigint, blob binary"
    docs.mapInArrow(pack, kind).write.option("compression", "none").parquet(path)
    chunks = spark.read.schema(kind).parquet(path)
    total = int(chunks.agg(F.sum("size")).first()[0] or 0)
    bits = max(6, (total // (16 << 20)).bit_length())
    out_bits = max(6, (total // (4 << 20)).bit_length())

    hashes = chunks.select("chunk", "blob").mapInArrow(lambda rows: _pack_hashes(rows, bits, width), "chunk bigint, bucket bigint, n bigint, blob binary")
    masks = hashes.groupBy("bucket").applyInPandas(
        lambda p: _repeated_hashes(p, hot), "chunk bigint, bucket bigint, mask binary, hot binary")
    by_chunk = chunks.select("chunk", "blob").groupBy("chunk")
    segments = by_chunk.cogroup(masks.groupBy("chunk")).applyInPandas(
        lambda a, b: _segments(a, b, bits, out_bits, width), "chunk bigint, bucket bigint, n bigint, blob binary")
    marks = segments.groupBy("bucket").applyInPandas(lambda p: _marks(p, out_bits, width), "chunk bigint, marks binary, strings binary")

    def last(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return finish(*_cut(a, b, width))

    return by_chunk.cogroup(marks.groupBy("chunk")).applyInPandas(last, schema)


def op2(docs: DataFrame) -> DataFrame:
    def finish(table: pa.Table, r: pd.DataFrame) -> pd.DataFrame:
        r["doc_id"] = table["doc_id"].to_pandas().astype("Int64")
        r["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in r["kept"]]
        return r[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]

    return dedup(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                 "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", finish)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from the texts, n_chars (if there is one) recounted.

    A character of which bytes are cut goes whole. Texts that nothing is cut from stay as they are."""
    names = docs.columns

    def finish(table: pa.Table, r: pd.DataFrame) -> pd.DataFrame:
        out = table.to_pandas(integer_object_nulls=True)
        cut = r["n_removed"].to_numpy() > 0
        out["text"] = [k.decode("utf-8", "ignore") if c else t for k, c, t in zip(r["kept"], cut, out["text"])]
        if "n_chars" in names:
            out["n_chars"] = [len(t) if c else n for t, c, n in zip(out["text"], cut, out["n_chars"])]
        return out[names]

    return dedup(docs, docs.schema, finish)
