"""Sampled subword segmentation over the piece lattice, and lossless decoding.

A text's lattice has a node between any two characters and an edge for every vocabulary piece
that spells the characters between two nodes. Forward filtering sums the weights of all paths to
each node; backward sampling draws the last piece of what is left, from the end to the start, so
each segmentation comes up with its probability. The draws are a hash of seed, row key, word and
step: the same row gets the same segmentation in any batch, partition or retry.

No piece crosses from a word into the space mark of the next one, so lattices are built once for each
distinct word of a chunk. A piece's weight is Zipf's: 1 / (rank + SHIFT), to the power ``alpha``; the
vocabulary gives ranks only. Characters without a piece are spelled in bytes. Spaces become the
space mark; a space mark that stands in the text is spelled in bytes, so decoding restores every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import small_batches, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose lattice is in memory at a time: about 250 bytes a byte.
ENCODED = T.CHUNK // 8
MARK, OWN_MARK = 0x2581, 0x110000
SHIFT = 10.0
_BITS = 18


def _prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums for hashes of any codes[a:z]: (sums[z] - sums[a]) * inverse power[a], then mixed."""
    n = len(codes)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, T.U)
        np.cumsum(T.mix(codes.astype(T.U) + T.U(0x51ED27)) * T.powers(int(T._P), n)[:n], out=sums[1:])
    return sums, T.powers(T.inverse(int(T._P)), n + 1)


class Table:
    """Map from 64-bit hashes to integers by two-choice hashing; lookups are array operations."""

    def __init__(self, keys: dict[int, int]):
        self.key = np.zeros((2, 1 << _BITS), T.U)
        self.value = np.full((2, 1 << _BITS), -2, np.int32)
        slot: list[dict[int, int]] = [{}, {}]
        for k in keys:
            side, turns = 0, 0
            while True:
                at = self._at(k, side)
                k, slot[side][at] = slot[side].get(at), k
                if k is None:
                    break
                side, turns = 1 - side, turns + 1
                if turns > 500:
                    raise ValueError("vocabulary too large for its table")
        for side in (0, 1):
            for at, k in slot[side].items():
                self.key[side, at], self.value[side, at] = k, keys[k]

    @staticmethod
    def _at(k: int, side: int) -> int:
        return (k >> (64 - _BITS)) if side == 0 else (k & ((1 << _BITS) - 1))

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value, or -2 where there is none."""
        a, b = (h >> T.U(64 - _BITS)).astype(np.int64), (h & T.U((1 << _BITS) - 1)).astype(np.int64)
        return np.where(self.key[0, a] == h, self.value[0, a], np.where(self.key[1, b] == h, self.value[1, b], np.int32(-2)))


class Vocabulary:
    """Pieces of a sentencepiece model: hashes of all their prefixes, ranks, bytes."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        self.byte_id = np.zeros(256, np.int32)
        spelled, entries = [b""] * n, {}
        ranks = np.full(n, float(n))
        self.known: set[int] = set()
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                spelled[i] = bytes([value])
            elif not (p.is_control(i) or p.is_unknown(i)):
                spelled[i] = piece.replace("▁", " ").encode()
                codes = np.array([ord(c) for c in piece])
                sums, power = _prefix_hash(codes)
                with np.errstate(over="ignore"):
                    hashes = T.mix((sums[1:] - sums[0]) * power[0]).tolist()
                for h in hashes[:-1]:
                    entries.setdefault(h, -1)
                entries[hashes[-1]] = i
                ranks[i] = i + 1
                self.known.update(codes.tolist())
        self.longest = max(len(p.id_to_piece(i)) for i in range(n) if not p.is_byte(i) and not p.is_control(i))
        self.table = Table(entries)
        self.weight = -np.log(ranks + SHIFT)
        self.weight[self.byte_id] = -np.log(n + SHIFT)
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        known = np.zeros(0x110001, bool)
        known[[c for c in self.known if c < 0x110000]] = True
        self.has_piece = known


def draw(seed: int, key: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for (row key, word, step)."""
    with np.errstate(over="ignore"):
        h = T.mix(T.mix(key + T.U(seed % 2**64) * T.U(0x9E3779B97F4A7C15)) + unit.astype(T.U) * T._Q + T.U(step))
    return (h >> T.U(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Edges of distinct words by end node, with the cumulative probabilities that sampling needs."""

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, off: np.ndarray, alpha: float):
        n = len(codes)
        self.off = off
        unit_end = np.repeat(off[1:], np.diff(off))
        starts, ends, ids = [], [], []
        sums, power = _prefix_hash(codes)
        at = np.flatnonzero(vocab.has_piece[codes])
        single = np.zeros(n, bool)
        for length in range(1, vocab.longest + 1):
            at = at[at + length <= unit_end[at]]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                value = vocab.table.get(T.mix((sums[at + length] - sums[at]) * power[at]))
            hit = value >= 0
            starts.append(at[hit])
            ends.append(at[hit] + length)
            ids.append(value[hit])
            if length == 1:
                single[at[hit]] = True
            at = at[value > -2]
        # a character without a piece of its own is an edge of bytes, marked by its negative code
        bare = np.flatnonzero(~single)
        starts.append(bare)
        ends.append(bare + 1)
        ids.append(-1 - codes[bare].astype(np.int64))
        start, end, self.piece = (np.concatenate(x).astype(np.int64) for x in (starts, ends, ids))
        width = np.where(self.piece < 0, _byte_count(-1 - np.minimum(self.piece, -1)), 1)
        weight = alpha * np.where(self.piece < 0, width * vocab.weight[vocab.byte_id[0]], vocab.weight[np.maximum(self.piece, 0)])
        begin = np.repeat(off[:-1], np.diff(off))  # of the unit of each character
        local = end - begin[end - 1]
        order = np.argsort((local * (n + 1) + end) * 32 + (end - start))
        start, end, weight, self.piece, local = start[order], end[order], weight[order], self.piece[order], local[order]
        # node k stands after character k-1; a unit's first node is never a target
        score = np.zeros(n + 1)
        total = np.empty(len(start))
        node = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        step = np.searchsorted(local, np.arange(1, (local[-1] if len(local) else 0) + 2))
        first_node = np.searchsorted(node, step)
        origin = start == begin[end - 1]
        for p in range(len(step) - 1):
            a, z = step[p], step[p + 1]
            total[a:z] = np.where(origin[a:z], 0.0, score[start[a:z]]) + weight[a:z]
            heads = node[first_node[p] : first_node[p + 1]]
            score[end[heads]] = np.logaddexp.reduceat(total[a:z], heads - a)
        cum = np.cumsum(np.exp(total - score[end]))
        rank = np.cumsum(np.concatenate([[True], end[1:] != end[:-1]])) - 1 if len(end) else node
        self.upto = cum - np.concatenate([[0.0], cum])[node][rank]  # within the node's edges
        self.upto[np.append(node[1:], len(end)) - 1] = 2.0
        self.start = start
        self.first_edge = np.zeros(n + 1, np.int64)
        self.first_edge[end[node]] = node

    def sample(self, unit: np.ndarray, key: np.ndarray, number: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """unit: of each occurrence. Returns (edges in reading order, offsets by occurrence)."""
        where = self.off[unit + 1]
        begin = self.off[unit]
        alive = np.arange(len(unit))
        taken, of, steps = [], [], []
        step = 0
        while len(alive):
            edge = self.first_edge[where[alive]]
            u = draw(seed, key[alive], number[alive], step)
            past = np.flatnonzero(self.upto[edge] <= u)
            while len(past):
                edge[past] += 1
                past = past[self.upto[edge[past]] <= u[past]]
            taken.append(edge)
            of.append(alive)
            steps.append(np.full(len(alive), step))
            where[alive] = self.start[edge]
            alive = alive[where[alive] > begin[alive]]
            step += 1
        edge, occurrence, step_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (taken, of, steps))
        count = np.bincount(occurrence, minlength=len(unit))
        ends = np.cumsum(count)
        out = np.empty(len(edge), np.int64)
        out[ends[occurrence] - 1 - step_of] = edge
        return out, np.append(0, ends)


def _byte_count(code: np.ndarray) -> np.ndarray:
    return np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where((code < 0x10000) | (code == OWN_MARK), 3, 4)))


def _spell(vocab: Vocabulary, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with byte edges spelled out, how many ids each edge became)."""
    bare = piece < 0
    if not bare.any():
        return piece, np.ones(len(piece), np.int64)
    code = -1 - piece[bare]
    code = np.where(code == OWN_MARK, MARK, code)
    data = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    count = np.ones(len(piece), np.int64)
    count[bare] = _byte_count(code)
    ends = np.cumsum(count)
    out = np.repeat(piece, count)
    out[np.repeat(bare, count)] = vocab.byte_id[data]
    del ends
    return out, count


def encode_texts(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, alpha: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets by text). An empty or null text has no ids."""
    codes = [np.frombuffer(("▁" + t).encode("utf-32-le"), "<u4") if t else np.zeros(0, "<u4") for t in texts]
    length = np.array([len(c) for c in codes], np.int64)
    off = np.concatenate([[0], np.cumsum(length)])
    code = np.concatenate(codes).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    first = off[:-1][length > 0]
    own = code == MARK
    own[first] = False
    code[own] = OWN_MARK
    code[code == 0x20] = MARK
    # units begin at a text, at a space mark after anything else, and around characters without any piece
    mark, bare = code == MARK, ~vocab.has_piece[code]
    cut = np.zeros(len(code), bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | bare[1:] | bare[:-1]
    cut[first] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(code))
    sums, power = _prefix_hash(code)
    with np.errstate(over="ignore"):
        h = T.mix(T.mix((sums[end] - sums[begin]) * power[begin]) + (end - begin).astype(T.U))
    _, sample_of, unit = np.unique(h, return_index=True, return_inverse=True)
    size = (end - begin)[sample_of]
    unit_off = np.concatenate([[0], np.cumsum(size)])
    flat = code[np.repeat(begin[sample_of] - unit_off[:-1], size) + np.arange(unit_off[-1])]
    lattice = Lattice(vocab, flat, unit_off, alpha)
    text_of = np.searchsorted(off, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, off[:-1])[text_of]
    edges, by_unit = lattice.sample(unit, keys[text_of], number, seed)
    ids, count = _spell(vocab, lattice.piece[edges])
    total = np.concatenate([[0], np.cumsum(count)])
    return ids.astype(np.int32), total[by_unit[np.searchsorted(begin, off)]]


_REPLACED = "\ufffd".encode()


def decode_ids(vocab: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The bytes that each text's ids spell, without the leading space mark."""
    known = (ids >= 0) & (ids < len(vocab.size))
    safe = np.where(known, ids, 0)
    # an id that the vocabulary doesn't have spells the replacement character
    size = np.where(known, vocab.size[safe], len(_REPLACED))
    begin = np.where(known, vocab.begin[safe], len(vocab.bytes))
    at = np.concatenate([[0], np.cumsum(size)])
    spelled = vocab.bytes if known.all() else np.concatenate([vocab.bytes, np.frombuffer(_REPLACED, np.uint8)])
    data = spelled[np.repeat(begin - at[:-1], size) + np.arange(at[-1])].tobytes()
    return [data[a + (data[a] == 32) : z] if z > a else b"" for a, z in zip(at[off[:-1]].tolist(), at[off[1:]].tolist(), strict=True)]


def _row_keys(ids: np.ndarray) -> np.ndarray:
    return T.mix(ids.astype(np.int64).view(T.U))


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(id, text, kept columns) of rows with an id, and the names of the kept ones in it."""
    inner = [f"k{i}" for i in range(len(keep))]  # kept columns may have any name
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)]), inner


def _encoder(vocab: Broadcast, alpha: float, seed: int, inner: list[str]):
    """Rows (id, text, kept ones) -> (id, pieces, kept ones)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _row_keys(T.id_array(b.column(0)))
            _, off = T.string_bytes(b.column(1))
            for i, j in T.chunks(off, ENCODED):
                part = b.slice(i, j - i)
                ids, cut = encode_texts(vocab.value, part.column(1).to_pylist(), keys[i:j], alpha, seed)
                pieces = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([part.column(0), pieces, *part.columns[2:]], names=["id", "pieces", *inner])

    return run


def _decoder(vocab: Broadcast, inner: list[str]):
    """Rows (id, pieces, kept ones) -> (id, text, kept ones)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                lists = part.column(1)
                off = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                texts = [t.decode(errors="replace") for t in decode_ids(vocab.value, ids, off - off[0])]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), *part.columns[2:]], names=["id", "text", *inner])

    return run


def sample_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0, keep: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """Rows (id, pieces array<int>, keep...): one sampled segmentation of each text, drawn by the row's id.

    Null and empty texts have no pieces. Rows that repeat an id and a text repeat its
    segmentation; rows without an id are left out. ``alpha`` flattens (towards 0) or sharpens (over 1)
    the distribution. The model file is read on the driver only.
    """
    small_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # a vocabulary: a fixed size
    if "pieces" in keep or id_col in keep:
        raise ValueError("pieces and the id are in the result anyway; name the column otherwise")
    rows, inner = _rows(docs, id_col, text_col, keep)
    schema = ", ".join(["id long", "pieces array<int>", *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner)])

    return spread(rows).mapInArrow(_encoder(vocab, alpha, seed, inner), schema).toDF(id_col, "pieces", *keep)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", keep: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """Rows (id, text, keep...): the texts that piece ids spell. No or null pieces give an empty text.

    What ``sample_encode`` made comes back as it was. Of other pieces, a null id or one outside the vocabulary, and bytes that are no
    UTF-8, become replacement characters (U+FFFD).
    """
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    if "text" in keep or id_col in keep:
        raise ValueError("text and the id are in the result anyway; name the column otherwise")
    inner = [f"k{i}" for i in range(len(keep))]
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(pieces_col), F.array().cast("array<int>")).alias("pieces"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)])
    schema = ", ".join(["id long", "text string", *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner)])

    return spread(rows).mapInArrow(_decoder(vocab, inner), schema).toDF(id_col, "text", *keep)


def encode_decoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0, keep: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """Rows (id, text, pieces, keep...): ``decode`` of what ``sample_encode`` gives, with its pieces, in one pass.

    One after the other in a plan they hold two Python workers a task, and executors keep them for all later work.
    """
    small_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    if {"pieces", "text", id_col} & set(keep):
        raise ValueError("pieces, text and the id are in the result anyway; name the column otherwise")
    rows, inner = _rows(docs, id_col, text_col, keep)
    schema = ", ".join(["id long", "text string", "pieces array<int>", *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner)])
    encoder, decoder = _encoder(vocab, alpha, seed, inner), _decoder(vocab, ["pieces", *inner])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoder(pa.record_batch([*b.columns[:2], *b.columns[1:]], names=["id", "of", *b.schema.names[1:]]) for b in encoder(batches))

    return spread(rows).mapInArrow(run, schema).toDF(id_col, "text", "pieces", *keep)


def round_trip(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0, model: str = MODEL) -> DataFrame:
    """(id, n_pieces, pieces_sha256, text_sha256 of the decoded text, lossless) for each document."""
    marked = docs.withColumn("source_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    both = encode_decoded(marked, id_col, text_col, alpha, seed, ("source_sha",), model)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return both.select(id_col, F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", " ").cast("binary"), 256).alias("pieces_sha256"), sha.alias("text_sha256"), (sha == F.col("source_sha")).alias("lossless"))
