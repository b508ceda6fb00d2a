"""Cross-tokenizer alignment over distinct texts (operator 13).

Two tokenizers cut the same bytes differently. Their tokens are aligned by byte offsets: where a
token of A and one of B end together a group ends, and two tokens are linked if their byte ranges
overlap. How often a pair of ids is linked in the whole corpus tells how good a link is.

1. The documents are shuffled by full text; each distinct text remains once, with its multiplicity.
2. Each distinct text is tokenised and aligned once, in chunks of about ``CHUNK_BYTES`` of text. A
   chunk becomes one row: its texts with their measures, the distinct id pairs with their counts
   (weighted by multiplicity), and which pairs each text's links are. The rows are written out.
3. The pair counts of all chunks are summed, and each B id's highest count is marked on its pairs.
4. Counts go back to the chunks that hold the pair, and from there to their texts.
5. The measures are joined to the doc_ids by the SHA-256 of the text.

Within a chunk, a text is cut at single blanks between a letter or `.,;:!?` and a letter (all ASCII).
Neither tokenizer has a token across such a blank: the pattern of A ends one there and no piece of B
has a blank behind another character (``Pair.joins`` checks the models, and texts stay whole otherwise). So each distinct piece
of a chunk is encoded once, as blank and piece for A and as piece for B, and the text's tokens are
the pieces' tokens.

A is a byte-level BPE of the `tokenizers` format, B a sentencepiece model. Both files are read where
the job is started and go to the tasks by broadcast; their size is checked (``MODEL_BYTES``).

Rules for odd rows: null and empty texts, and texts whose joined A or B bytes differ from blank and
text, have no tokens: zeros and an empty groups_sha256. Repeated documents each get a row, and count
each time. Null doc_ids are kept. An empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import stage

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
CHUNK_BYTES = 2 << 20
BLOCK = 1 << 8  # plain pieces encoded in one call

# Fixed value: how byte-level vocabularies of this kind cut a text before their merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = f"(?<=[{_LETTER}.,;:!?]) (?=[{_LETTER}])"
# kinds of letters below U+0250 are the same in all versions of Unicode that libraries carry
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_PLAIN = f"^[{_LETTER}]([\\x00-\\x{{24f}}]*[{_LETTER}.,;:!?])?\\z"
_TEXT_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are
    themselves, the other bytes are numbered from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; tokenizers of at most {MODEL_BYTES} are sent to the tasks")
    return data


class Pair:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece

        self.source_a = a
        letters, model = byte_letters(), json.loads(a)
        vocab = model["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters.get(c, 0) for c in token)
        self.by_rank = self._by_rank(model)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                        for p in pieces]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # each id as text, followed by what can follow it: the next of its side, or the other side
        self.written = [b"%d%s" % (i, end) for n, ends in ((len(self.size_a), b",|"), (len(self.size_b), b",;"))
                        for end in (ends[:1], ends[1:]) for i in range(n)]

    @cached_property
    def a(self):
        """Tokenizer A itself; loaded where ranks don't do."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.source_a.decode())
        out.encode_special_tokens = True
        return out

    @property
    def joins(self) -> bool:
        """Whether texts may be cut and their plain pieces be encoded together."""
        return self.by_rank is not None and not any(re.search(b"[^ ] ", x) for x in self.bytes_b)

    def _by_rank(self, model: dict):
        """The same vocabulary as byte ranks, which encode short pieces faster; None if its ids aren't ranks."""
        import tiktoken

        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        before = model["pre_tokenizer"]
        if made != sorted(made) or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            return None
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {self.bytes_a[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many a piece has, the same for B, and whether a piece's joined bytes are those of
        blank and piece on both sides; without ids where not."""
        a = [self.by_rank.encode_ordinary(" " + p) if self.by_rank and not _BEYOND_LATIN.search(p)
             else self.a.encode(" " + p, add_special_tokens=False).ids for p in pieces]
        b = self.b.encode(pieces, num_threads=1)
        ok = np.zeros(len(pieces), bool)
        for i, p in enumerate(pieces):
            raw = b" " + p.encode()
            ok[i] = b"".join([self.bytes_a[x] for x in a[i]]) == raw == b"".join([self.bytes_b[x] for x in b[i]])
            if not ok[i]:
                a[i], b[i] = [], []
        flat = [np.array([*chain.from_iterable(x)], np.int64) for x in (a, b)]
        sizes = [np.array([len(y) for y in x], np.int64) for x in (a, b)]
        return flat[0], sizes[0], flat[1], sizes[1], ok

    def encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As encode_each, for pieces between which both sides end a token (``_PLAIN``): all in one call."""
        text = " ".join(pieces)
        raw = b" " + text.encode()
        ends = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode())) for p in pieces])
        out = []
        for ids, size, made in ((self.by_rank.encode_ordinary(" " + text), self.size_a, self.bytes_a),
                                (self.b.encode(text, num_threads=1), self.size_b, self.bytes_b)):
            flat = np.array(ids, np.int64)
            at = np.cumsum(size[flat])
            last = np.searchsorted(at, ends)
            if b"".join([made[x] for x in ids]) != raw or (at[last] != ends).any():
                return self.encode_each(pieces)
            out += [flat, np.diff(last + 1, prepend=0)]
        return *out, np.ones(len(pieces), bool)

    def encode(self, pieces: list[str], plain: int) -> tuple[np.ndarray, ...]:
        """encode_joined of the first ``plain`` pieces in blocks, then encode_each of the others."""
        blocks = [self.encode_joined(pieces[i:min(i + BLOCK, plain)]) for i in range(0, plain, BLOCK)]
        return tuple(map(np.concatenate, zip(*blocks, self.encode_each(pieces[plain:]))))


class Aligned:
    """The alignment of many pieces, the first ``plain`` of them plain: per piece counts, links as id
    pairs, and its groups as text."""

    def __init__(self, pair: Pair, pieces: list[str], plain: int) -> None:
        ids_a, self.n_a, ids_b, self.n_b, self.ok = pair.encode(pieces, plain)
        # all pieces side by side: both sides cover the same bytes, so ends can be marked byte by byte
        end_a, end_b = np.cumsum(pair.size_a[ids_a]) - 1, np.cumsum(pair.size_b[ids_b]) - 1
        size = int(end_a[-1]) + 1 if len(end_a) else 0
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[end_a], in_b[end_b] = True, True
        shared = in_a & in_b
        upto_a, upto_b, upto_s = (np.cumsum(x, dtype=np.int32) for x in (in_a, in_b, shared))
        cuts = np.flatnonzero(in_a | in_b)  # each stretch between two of them is one overlap of two tokens
        self.links = ids_a[upto_a[cuts] - in_a[cuts]] << 32 | ids_b[upto_b[cuts] - in_b[cuts]]
        filled = self.n_a > 0
        piece_end = end_a[np.cumsum(self.n_a)[filled] - 1]
        self.n_groups, self.n_links = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        self.n_groups[filled] = np.diff(upto_s[piece_end], prepend=0)
        self.n_links[filled] = np.diff(np.searchsorted(cuts, piece_end, "right"), prepend=0)
        self.link_at = np.concatenate([[0], np.cumsum(self.n_links)])
        # one sequence of all tokens, group by group, A before B
        last_a, last_b = shared[end_a], shared[end_b]
        group_a, group_b = upto_s[end_a] - last_a, upto_s[end_b] - last_b
        group_end = np.flatnonzero(shared)
        order_a = np.arange(len(ids_a)) + np.concatenate([[0], upto_b[group_end]])[group_a]
        order_b = np.arange(len(ids_b)) + upto_a[group_end][group_b] if len(ids_b) else np.zeros(0, np.int64)
        forms = np.empty(len(ids_a) + len(ids_b), np.int64)
        na, nb = len(pair.size_a), len(pair.size_b)
        forms[order_a] = ids_a + na * last_a
        forms[order_b] = ids_b + 2 * na + nb * last_b
        tokens = [pair.written[f] for f in forms.tolist()]
        stop = np.cumsum(self.n_a + self.n_b).tolist()
        self.text = [b"".join(tokens[i:j])[:-1] for i, j in zip([0, *stop], stop)]


CHUNK_SCHEMA = """chunk bigint, digests array<binary>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>,
n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, weights array<bigint>,
text_ends binary, refs binary, ref_times binary, piece_ends binary, piece_pairs binary"""


def small(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


def open_small(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int32)


def chunk_row(pair: Pair, number: int, digests: list[bytes], mult: np.ndarray, sizes: np.ndarray, parts: pa.Array) -> pa.RecordBatch:
    """The row of a chunk: digest, multiplicity and number of pieces of each text, and the pieces of all texts."""
    parts = parts.dictionary_encode()
    plain = pc.match_substring_regex(parts.dictionary, _PLAIN).to_numpy(zero_copy_only=False) & pair.joins
    order = np.argsort(~plain, kind="stable")
    done = Aligned(pair, parts.dictionary.take(pa.array(order)).to_pylist(), int(plain.sum()))
    n_pieces = len(order)
    moved = np.empty(n_pieces, np.int64)
    moved[order] = np.arange(n_pieces)
    refs = moved[parts.indices.to_numpy()]
    pairs, at = np.unique(done.links, return_inverse=True)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    total = lambda x: np.add.reduceat(x[refs], starts)
    good = total(~done.ok) == 0
    measures = [np.where(good, total(x), 0) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)]
    shas = [hashlib.sha256(b";".join([done.text[k] for k in refs[i:j].tolist()])).hexdigest() if g else ""
            for i, j, g in zip(starts.tolist(), stops.tolist(), good.tolist())]
    # how often each text holds each piece
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    use = good[text_of]
    held, times = np.unique(text_of[use] * n_pieces + refs[use], return_counts=True)
    held_text, held_piece = held // n_pieces, held % n_pieces
    piece_weight = np.zeros(n_pieces, np.int64)
    np.add.at(piece_weight, held_piece, mult[held_text] * times)
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, at, np.repeat(piece_weight, done.n_links))
    used = weights > 0  # pieces only of texts without tokens count nothing
    arrays = [[number], [digests], *([x] for x in measures), [shas], [pairs[used]], [weights[used]],
              [small(np.searchsorted(held_text, np.arange(len(sizes)), "right"))], [small(held_piece)], [small(times)],
              [small(done.link_at[1:])], [small((np.cumsum(used) - 1)[at])]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, _ARROW)], schema=_ARROW)


_ARROW = pa.schema([
    ("chunk", pa.int64()), ("digests", pa.list_(pa.binary())), *((c, pa.list_(pa.int64())) for c in _TEXT_COLUMNS),
    ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
    *((c, pa.binary()) for c in ("text_ends", "refs", "ref_times", "piece_ends", "piece_pairs"))])


_LOADED: dict[bytes, Pair] = {}


def loaded(a: bytes, b: bytes) -> Pair:
    """The tokenizers of this process, read once."""
    key = hashlib.sha256(a + b).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(a, b)
    return _LOADED[key]


def chunks(texts: DataFrame, a: bytes, b: bytes, chunk_bytes: int) -> DataFrame:
    """One row a chunk of distinct texts (text, digest, multiplicity)."""
    models = texts.sparkSession.sparkContext.broadcast((a, b))
    parts = F.split("text", _CUT, -1) if loaded(a, b).joins else F.array("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = loaded(*models.value), TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            lists = rows["parts"].chunk(0)
            return chunk_row(pair, number, rows["digest"].to_pylist(), rows["multiplicity"].to_numpy(),
                             np.diff(lists.offsets.to_numpy()), lists.flatten())

        filled = 0
        for batch in batches:
            upto = np.cumsum(batch["size"].to_numpy())
            first = 0
            while first < batch.num_rows:
                room = chunk_bytes - filled + (upto[first - 1] if first else 0)
                last = max(first + 1, int(np.searchsorted(upto, room, "right")))
                waiting.append(batch.slice(first, last - first))
                filled += upto[last - 1] - (upto[first - 1] if first else 0)
                first = last
                if filled >= chunk_bytes or first < batch.num_rows:
                    yield flush()
                    number, filled = number + 1, 0
                    waiting.clear()
                    pa.default_memory_pool().release_unused()
        if waiting:
            yield flush()

    return texts.select("digest", "multiplicity", F.octet_length("text").alias("size"), parts.alias("parts")).mapInArrow(run, CHUNK_SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Each linked id pair with its corpus-wide count and whether it is its B id's highest."""
    counts = (rows.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("links")))
    counts = stage(counts, "alignment-pairs").withColumn("id_b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("id_b").agg(F.max("links").alias("most"))
    return counts.join(most, "id_b").select("pair", F.shiftright("pair", 32).alias("id_a"), "id_b", "links",
                                            (F.col("links") == F.col("most")).alias("best"))


_SCORED = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in _TEXT_COLUMNS), ("groups_sha256", pa.string()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64())])


def score_chunk(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The measures of each text of one chunk, given count and best flag of the chunk's pairs."""
    row = {c: rows[c][0].as_py() for c in rows.column_names if c not in ("pairs", "weights")}
    pairs = rows["pairs"].combine_chunks().flatten().to_numpy()
    keys = known["pair"].to_numpy()
    order = np.argsort(keys)
    place = order[np.searchsorted(keys, pairs, sorter=order)] if len(pairs) else np.zeros(0, np.int64)
    links, best = known["links"].to_numpy()[place], known["best"].to_numpy()[place].astype(np.int64)
    piece_ends, piece_pairs = open_small(row["piece_ends"]), open_small(row["piece_pairs"])
    refs, times, text_ends = open_small(row["refs"]), open_small(row["ref_times"]).astype(np.int64), open_small(row["text_ends"])
    ends = lambda x, at: np.concatenate([[0], np.cumsum(x)])[at]
    sums = []
    for value in (best, links):
        per_link = value[piece_pairs] if len(value) else np.zeros(len(piece_pairs), np.int64)
        per_piece = np.diff(ends(per_link, piece_ends), prepend=0)
        sums.append(np.diff(ends(per_piece[refs] * times, text_ends), prepend=0))
    values = [row["digests"], *(row[c] for c in _TEXT_COLUMNS), row["groups_sha256"], *sums]
    return pa.table([pa.array(v, f.type) for v, f in zip(values, _SCORED)], schema=_SCORED)


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Measures per row of docs (doc_id and the measures), and the corpus-wide counts of linked id pairs."""
    texts = (docs.filter("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("multiplicity"))
             .withColumn("digest", F.unhex(F.sha2("text", 256))))
    rows = stage(chunks(texts, read_model(a), read_model(b), chunk_bytes), "alignment-chunks")
    counts = stage(pair_counts(rows), "alignment-counts")
    held = rows.select(F.col("chunk").alias("at"), F.explode("pairs").alias("pair")).join(counts.select("pair", "links", "best"), "pair")
    fields = "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    measures = rows.drop("weights").groupBy("chunk").cogroup(held.groupBy("at")).applyInArrow(score_chunk, fields)
    ids = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    numbers = [*_TEXT_COLUMNS, "n_best", "count_sum"]
    found = ids.join(measures, "digest", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return found, counts


def op13(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    return align(docs, a, b)[0]
