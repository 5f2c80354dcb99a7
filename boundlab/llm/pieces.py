"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can cross (before white space that
follows other characters), each different segment is taken once, and all are
concatenated. A suffix array over this text is built by prefix doubling up to
the longest piece. Every piece's occurrences are one range of it, found for all
pieces at once by binary search, level by level. Scattering the ranges by
position gives the edges in order of position, and the edges are relaxed:

* unigram models: best-scoring path over the positions (Viterbi);
* BPE models: the best-scoring edge that joins two neighbouring tokens, leftmost
  first, is taken again and again. A path relaxation can't give BPE's ids.

Whole texts are encoded; ids equal the sentencepiece library's. Characters
without a piece become byte pieces, or the unknown id where a model has none.
Decoding gives the text back, but for U+2581, which the models read as a space.

Models with a normalisation table aren't supported. Memory follows the batch
(about 1 million bytes) or one longer text. Of a text without spaces, which is one
segment, edges take 4 bytes for each character and length of a piece.

Nulls: a null or empty text has no tokens. Rows are independent, so repeated
rows, null ids and extra columns need no care. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table

SEGMENT = re.compile(" *[^ ]+| +")
BATCH, SHORT = 1_000_000, 64
SPACE = "▁"


def fields(raw: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """A vocabulary, read from a SentencePiece model file on the driver and shipped to the tasks."""

    def __init__(self, raw: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(raw)
        parts = list(fields(raw))
        trainer = dict(f for n, v in parts if n == 2 for f in fields(v))
        rules = dict(f for n, v in parts if n == 3 for f in fields(v))
        if rules.get(2) or rules.get(4, 1):
            raise ValueError("models that normalise their input aren't supported")
        self.bpe, self.prefix = trainer.get(3, 1) == 2, bool(rules.get(3, 1))
        n = sp.get_piece_size()
        self.unknown, self.scores = sp.unk_id(), np.array([sp.get_score(i) for i in range(n)])
        kinds = [0 if sp.is_control(i) else 1 if sp.is_unknown(i) else 2 if sp.is_byte(i) else 3 for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_ = np.full(256, -1, np.int32)
        self.out: list[bytes] = []
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == 2:
                self.bytes_[int(p[3:5], 16)] = i
            self.out.append((b"", " ⁇ ".encode(), bytes([int(p[3:5], 16)]) if kind == 2 else b"", p.replace(SPACE, " ").encode())[kind])
        self.ids = np.array([i for i in range(n) if kinds[i] == 3 and not sp.is_unused(i)], np.int32)
        kept = [pieces[i].replace(SPACE, " ") for i in self.ids]
        self.crossing = any(re.search("[^ ] ", p) for p in kept)
        self.chars = {c: k + 1 for k, c in enumerate(sorted(set("".join(kept))))}
        if len(self.chars) >= 0xFFFF:
            raise ValueError("too many different characters for 16-bit codes")
        self.lengths = np.array([len(p) for p in kept])
        self.longest = int(self.lengths.max())
        self.width = 4
        while self.width < self.longest:
            self.width *= 2
        self.codes = np.zeros((len(kept), self.width), np.uint64)
        for k, p in enumerate(kept):
            self.codes[k, : len(p)] = [self.chars[c] for c in p]
        self.worst = float(self.scores[self.ids].min()) - 10.0
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def code(self, text: str) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(0x110000, np.uint64)
            for c, k in self.chars.items():
                self._table[ord(c)] = k
        return self._table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def pack(x: np.ndarray) -> np.ndarray:
    return x[0] << np.uint64(48) | x[1] << np.uint64(32) | x[2] << np.uint64(16) | x[3]


def edges(model: Model, code: np.ndarray) -> np.ndarray:
    """edges[n - 1, i]: the id of the piece of length n at position i, or -1. The last code is 0."""
    n, up = len(code), np.uint64(32)
    padded = np.concatenate([code, np.zeros(4, np.uint64)])
    key, width, levels = pack([padded[i : i + n] for i in range(4)]), 4, []
    while True:
        last = width >= model.width
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        levels.append(ranked[new])
        if last:
            break
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        ahead = np.zeros(n, np.uint64)  # beyond the end: rank 0, as of zeros alone
        ahead[: max(0, n - width)] = rank[width:]
        key, width = rank << up | ahead, 2 * width

    def ranges(level: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the ranks of its characters from `at` on, as many as the level is wide."""
        left = model.lengths - at
        if not level:
            part = model.codes[:, at : at + 4].T
            high = [np.where(left > i, part[i], np.uint64(0xFFFF)) for i in range(4)]
            return np.searchsorted(levels[0], pack(part)), np.searchsorted(levels[0], pack(high), side="right")
        half = 2 << level
        a, b = (x.astype(np.uint64) for x in ranges(level - 1, at))
        c, d = (x.astype(np.uint64) for x in ranges(level - 1, at + half))
        long = left > half
        low, high = np.where(long, a << up | c, a << up), np.where(long, a << up | d, b << up)
        lo, hi = np.searchsorted(levels[level], low), np.searchsorted(levels[level], high)
        return lo, np.where(long & (b <= a), lo, hi)

    low, high = ranges(len(levels) - 1, 0)
    starts = np.r_[np.flatnonzero(new), n]
    first, size = starts[low], starts[np.maximum(low, high)] - starts[low]
    at = order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
    found = np.full((model.longest, n), -1, np.int32)
    found[np.repeat(model.lengths - 1, size), at] = np.repeat(model.ids, size)
    return found


def relax_bpe(model: Model, found: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short segments side by side -> (segment, first position, length) of the tokens, in order."""
    n, most = len(base), int(size.max())
    cost = np.r_[-model.scores, np.inf]  # [-1]: no piece

    def joined(row, a, b):
        length = b - a
        fits = length <= model.longest
        return np.where(fits, cost[found[np.where(fits, length, 1) - 1, base[row] + a]], np.inf)

    grid = np.arange(most + 1)
    after, before = np.tile(grid + 1, (n, 1)), np.tile(grid - 1, (n, 1))
    alive = grid[None, :most] < size[:, None]
    price = np.full((n, most), np.inf)
    r, p = np.nonzero(grid[None, :most] + 1 < size[:, None])
    price[r, p] = joined(r, p, p + 2)
    rows = np.arange(n)
    while len(rows):
        now = price[rows]
        p = now.argmin(axis=1)
        ok = np.isfinite(now[np.arange(len(rows)), p])
        rows, p = rows[ok], p[ok]
        q = after[rows, p]
        end = after[rows, q]
        after[rows, p], alive[rows, q], price[rows, q], price[rows, p] = end, False, np.inf, np.inf
        more = end < size[rows]
        r, a, e = rows[more], p[more], end[more]
        before[r, e] = a
        price[r, a] = joined(r, a, after[r, e])
        b = before[rows, p]
        less = b >= 0
        r, b = rows[less], b[less]
        price[r, b] = joined(r, b, end[less])
    r, p = np.nonzero(alive)
    return r, p, after[r, p] - p


def relax_bpe_long(model: Model, found: np.ndarray, base: int, size: int) -> list[tuple[int, int]]:
    """(first position, length) of the tokens of one long segment, with a heap."""
    after, before, alive, heap = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size, []

    def offer(a, b):
        end = after[b]
        if end - a <= model.longest and (i := found[end - a - 1, base + a]) >= 0:
            heapq.heappush(heap, (-model.scores[i], a, b, end))

    for a in range(size - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not alive[a] or after[a] != b or not alive[b] or after[b] != end:
            continue
        alive[b], after[a] = False, end
        if end < size:
            before[end] = a
            offer(a, end)
        if before[a] >= 0:
            offer(before[a], a)
    return [(a, after[a] - a) for a in range(size) if alive[a]]


def relax_path(model: Model, found: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best path over the positions of each segment, position by position."""
    n, most = len(base), int(size.max())
    score = np.r_[model.scores, -np.inf]
    best, step = np.full((n, most + 1), -np.inf), np.ones((n, most + 1), np.int64)
    best[:, 0] = 0
    for end in range(1, most + 1):
        rows = np.flatnonzero(size >= end)
        for k in range(1, min(end, model.longest) + 1):
            piece = found[k - 1, base[rows] + end - k]
            value = best[rows, end - k] + (np.where(piece < 0, model.worst, score[piece]) if k == 1 else score[piece])
            better = value > best[rows, end]
            best[rows[better], end], step[rows[better], end] = value[better], k
    rows, at, out = np.arange(n), size.copy(), []
    while len(rows):
        k = step[rows, at[rows]]
        at[rows] -= k
        out.append((rows, at[rows], k))
        rows = rows[at[rows] > 0]
    r, p, k = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((p, r))
    return r[order], p[order], k[order]


def encode(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    known: dict[str, int] = {}
    sequence, parts = [], []
    for t in texts:
        t = t and (" " if model.prefix else "") + t.replace(SPACE, " ")
        cut = [] if not t else [t] if model.crossing else SEGMENT.findall(t)
        sequence += [known.setdefault(s, len(known)) for s in cut]
        parts.append(len(cut))
    if not known:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    segments = list(known)
    size = np.array([len(s) for s in segments])
    base = np.cumsum(size + 1) - size - 1
    whole = "\0".join(segments) + "\0"
    found = edges(model, model.code(whole))
    tokens, lower = [], 0
    for upper in (8, 16, 32, SHORT, None):
        rows = np.flatnonzero((size > lower) & (size <= (upper or size.max())))
        if len(rows) and upper:
            r, p, k = (relax_bpe if model.bpe else relax_path)(model, found, base[rows], size[rows])
            tokens.append((rows[r], p, k))
        elif not upper:
            for row in rows:
                one = relax_bpe_long(model, found, base[row], size[row]) if model.bpe else zip(*relax_path(model, found, base[[row]], size[[row]])[1:], strict=True)
                p, k = (np.array(x) for x in zip(*one, strict=True))
                tokens.append((np.full(len(p), row), p, k))
        lower = upper
    seg, p, k = (np.concatenate(x) for x in zip(*tokens, strict=True))
    order = np.argsort(seg, kind="stable")
    seg, p, k = seg[order], p[order], k[order]
    ids = found[k - 1, base[seg] + p]
    lost = np.flatnonzero(ids < 0)
    if len(lost):  # bytes for characters that have no piece
        spelled = [whole[i].encode("utf-8", "surrogatepass") for i in (base[seg] + p)[lost]]
        spelled = [[int(model.bytes_[x]) for x in s] if (model.bytes_ >= 0).all() else [model.unknown] for s in spelled]
        times = np.ones(len(ids), np.int64)
        times[lost] = [len(s) for s in spelled]
        put = np.repeat(ids < 0, times)
        ids, seg = np.repeat(ids, times), np.repeat(seg, times)
        ids[put] = [x for s in spelled for x in s]
    count = np.bincount(seg, minlength=len(segments))
    start = np.cumsum(count) - count
    order = np.array(sequence, np.int64)
    each = count[order]
    flat = ids[np.repeat(start[order] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    owner = np.repeat(np.arange(len(texts)), parts)
    return flat, np.bincount(owner, each, len(texts)).astype(np.int64)


def decode(model: Model, ids: list[int]) -> str:
    text = b"".join([model.out[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def batched(batches):
    """Slices of record batches with about BATCH bytes of text each."""
    for b in batches:
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in b.column("text")]) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, side="right"))
            end = max(at + 1, end)
            yield b.slice(at, end - at)
            at = end


def decoded(model: Model, tokens: pa.Array) -> pa.Array:
    """The texts of a list column, one row at a time."""
    return pa.array((decode(model, t.values.to_numpy().tolist()) if t.is_valid else None for t in tokens), pa.string())


def encoder(model: Model, back: bool = False):
    """Adds `tokens`, and `decoded` in the same worker if `back`."""

    def run(batches):
        for b in batched(batches):
            ids, counts = encode(model, b.column("text").to_pylist())
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            more = [decoded(model, tokens)] if back else []
            yield pa.RecordBatch.from_arrays([*b.columns, tokens, *more], [*b.schema.names, "tokens", *["decoded"] * back])

    return run


def decoder(model: Model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decoded(model, b.column("tokens"))], [*b.schema.names, "decoded"])

    return run


def checker(model: Model):
    """Encodes and decodes each text: the ids, and figures of both."""

    def run(batches):
        for b in batched(batches):
            texts = b.column("text").to_pylist()
            ids, counts = encode(model, texts)
            ends, rows = np.cumsum(counts), []
            spelled = np.isin(ids, model.bytes_)
            for t, end, n in zip(texts, ends, counts, strict=True):
                own = ids[end - n : end]
                back = decode(model, own.tolist())
                rows.append((n, int(spelled[end - n : end].sum()), crc32(own.astype("<i4").tobytes()), crc32(back.encode()), back == (t or "").replace(SPACE, " ")))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), tokens, *cols], ["doc_id", "tokens", "n_tokens", "n_bytes", "ids_crc32", "decoded_crc32", "round_trip"])

    return run


def read_model(path: str | None = None) -> Model:
    """From `path`, by default the 32k-piece model of the public_tokenizers package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return Model(f.read())


def encode_pieces(docs: DataFrame, model: Model, back: bool = False) -> DataFrame:
    """`docs` with `tokens` array<int>, the ids of `text`; if `back`, also with `decoded`, the text of `tokens`."""
    layout = docs.drop("tokens", *["decoded"] * back)
    more = [StructField("tokens", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * back]
    return layout.mapInArrow(encoder(model, back), StructType([*layout.schema.fields, *more]))


def decode_pieces(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with `decoded`, the text of `tokens`."""
    layout = rows.drop("decoded")
    return layout.mapInArrow(decoder(model), StructType([*layout.schema.fields, StructField("decoded", StringType())]))


def op3_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return docs.mapInArrow(checker(read_model(path)), "doc_id long, tokens array<int>, n_tokens long, n_bytes long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
