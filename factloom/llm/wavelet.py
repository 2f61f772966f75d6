"""Token ids in compressed files: one wavelet matrix per shard.

Documents are dealt in ranges of ascending id; a task encodes its range and cuts it into shards of about
``SHARD`` ids, whole documents each. A shard is one file that holds the ids as bit-planes, most
significant bit first, each plane a stable partition of the one before it by its bit. Planes lie in
blocks of ``BLOCK`` bytes, compressed one by one, with a directory that gives each block's place and the ones before
it; so access, counting and lookup of occurrences read a few blocks of the file, whatever its length.

Files are written under names of their own by each task attempt, and the manifest (Parquet, by Spark) lists those of the
attempts that ended well: a lost executor's half-written files are never read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import folder, settle, small_batches

#: Token ids of a shard, about; a longer document is a shard by itself.
SHARD = 1 << 21
#: Bytes of a block of a plane before compression.
BLOCK = 4096
#: The id that ends each document.
END = 0
MAGIC = b"WAVEMTX1"
#: White space by the bytes of its last character: ASCII, and what ends a longer one. No token of a byte-level vocabulary spans the border
#: between other characters and white space behind them, so texts are cut there, where ASCII white space begins.
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_WHITE = frozenset(" \t\n\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_LONG_WHITE = sorted(c.encode() for c in _WHITE if ord(c) > 127)
#: Pieces that a worker remembers at most, and the longest; bytes of texts encoded at a time.
REMEMBERED, LONGEST, CHUNK = 2_000_000, 64, 1 << 22
_MANIFEST = "part int, seq int, file string, docs long, tokens long, bytes long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- the file ---------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard file: ``ids`` of the documents ``docs`` one after another, ``lengths`` of them each."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    squeeze = zstandard.ZstdCompressor(level=1)
    body, at, size, ones, zeros = [], [], [], [], []
    where = len(MAGIC)
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits):
        bit = (values >> (bits - 1 - level)) & 1 != 0
        plane = np.packbits(bit, bitorder="little")
        zeros.append(int(n - np.count_nonzero(bit)))
        before = 0
        for i in range(0, len(plane), BLOCK):
            raw = plane[i : i + BLOCK]
            block = squeeze.compress(raw.tobytes())
            block = block if len(block) < len(raw) else raw.tobytes()  # kept as it is where it can't be made shorter
            body.append(block)
            at.append(where)
            size.append(len(block))
            ones.append(before)
            where += len(block)
            before += int(np.bitwise_count(raw).sum())
        values = np.concatenate([values[~bit], values[bit]])
    tables = [zlib.compress(np.asarray(x, "<i8").tobytes(), 1) for x in (docs, lengths, at, size, ones)]
    head = json.dumps({"tokens": n, "bits": bits, "zeros": zeros, "block": BLOCK, "tables": [len(t) for t in tables]}).encode()
    return b"".join([MAGIC, *body, *tables, head, len(head).to_bytes(8, "little"), MAGIC])


class Shard:
    """Reads a shard file (seekable, binary). Positions count from 0 within the shard."""

    def __init__(self, file):
        self._file = file
        end = file.seek(0, 2)
        file.seek(end - 16)
        tail = file.read(16)
        if end < 24 or tail[8:] != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(tail[:8], "little")
        file.seek(end - 16 - size)
        head = json.loads(file.read(size))
        self.n, self.bits, self.zeros, self.block = head["tokens"], head["bits"], head["zeros"], head["block"]
        at = end - 16 - size - sum(head["tables"])
        file.seek(at)
        tables = [np.frombuffer(zlib.decompress(file.read(k)), "<i8") for k in head["tables"]]
        self.docs, self.lengths, self._at, self._size, self._ones = tables
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._blocks = -(-self.n // (8 * self.block))
        self._unpack = zstandard.ZstdDecompressor()
        self._read = lru_cache(256)(self._read_block)

    def _read_block(self, k: int) -> np.ndarray:
        self._file.seek(int(self._at[k]))
        data = self._file.read(int(self._size[k]))
        plane, i = divmod(k, self._blocks)
        raw = min(self.block, -(-self.n // 8) - i * self.block)
        return np.frombuffer(data if len(data) == raw else self._unpack.decompress(data, max_output_size=raw), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        return int(self._read(level * self._blocks + i // (8 * self.block))[i // 8 % self.block]) >> (i & 7) & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, inside = divmod(i, 8 * self.block)
        if k == self._blocks:
            return self.n - self.zeros[level]
        have = int(self._ones[level * self._blocks + k])
        if inside:
            data = self._read(level * self._blocks + k)
            have += int(np.bitwise_count(data[: inside // 8]).sum()) + (int(data[inside // 8]) & ((1 << (inside & 7)) - 1)).bit_count() if inside & 7 else int(np.bitwise_count(data[: inside // 8]).sum())
        return have

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        ones = self._ones[level * self._blocks : (level + 1) * self._blocks]
        before = ones if bit else np.arange(self._blocks) * 8 * self.block - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        found = np.unpackbits(self._read(level * self._blocks + b), bitorder="little")
        return b * 8 * self.block + int(np.flatnonzero(found == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of an id between two positions stand after the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at positions lo..hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, lo: int = 0, hi: int | None = None) -> Iterator[int]:
        """Positions of an id between lo and hi, ascending."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        for k in range(a, b):
            for level in reversed(range(self.bits)):
                bit = token >> (self.bits - 1 - level) & 1
                k = self._select(level, bit, k - self.zeros[level] if bit else k)
            yield k

    def all(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane to the first."""
        values = np.zeros(self.n, np.uint32)
        for level in reversed(range(self.bits)):
            blocks = [self._read_block(level * self._blocks + b) for b in range(self._blocks)]
            bit = np.unpackbits(np.concatenate(blocks), count=self.n, bitorder="little").astype(bool) if blocks else np.zeros(0, bool)
            above = np.empty_like(values)
            above[~bit] = values[: self.zeros[level]]
            above[bit] = values[self.zeros[level] :] | np.uint32(1 << (self.bits - 1 - level))
            values = above
        return values


# -- encoding ---------------------------------------------------------------------------------------------------------


def cuts_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: each text, and ASCII white space behind a character that is none; the end of the bytes comes last."""
    at = np.flatnonzero(_ASCII_WHITE[raw])
    at = at[at > 0]
    at = at[~_ASCII_WHITE[raw[at - 1]]]
    wide = np.flatnonzero(raw[at - 1] >= 128)
    for c in _LONG_WHITE if len(wide) else ():
        ends = np.ones(len(wide), bool)
        for k, byte in enumerate(reversed(c)):
            ends &= raw[np.maximum(at[wide] - 1 - k, 0)] == byte
        at[wide[ends]] = 0
    mark = np.zeros(len(raw) + 1, bool)
    mark[at] = True
    mark[0] = False
    mark[offsets] = True
    return np.flatnonzero(mark)


def _spread_out(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of them, count of each."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - count), count)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position (zeros behind the end) as one integer."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def _alike(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Do the bytes x[a : a + size] equal y[b : b + size]? Up to 16 bytes are two words, that may overlap; longer ones are compared byte by byte."""
    v, w = _words(x), _words(y)
    low = np.minimum(size, 8)
    unused = ((8 - low) * 8).astype(np.uint64)
    back = np.maximum(size - 8, 0)
    same = ((v[a] ^ w[b]) << unused) == 0
    same &= ((v[a + back] ^ w[b + back]) << unused) == 0
    long = np.flatnonzero(same & (size > 16))
    if len(long):
        wrong = x[_spread_out(a[long], size[long])] != y[_spread_out(b[long], size[long])]
        same[long[np.unique(np.repeat(np.arange(len(long)), size[long])[wrong])]] = False
    return same


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each piece that a worker remembers.

    Pieces are found by hash and compared byte by byte, so what is remembered is exact.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(vocabulary)
        pre = json.loads(self._model.to_str())
        # cutting before white space is safe for this kind of vocabulary only; others get whole texts
        self._cut = pre.get("normalizer") is None and (pre.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and pre["pre_tokenizer"].get("use_regex") and not pre["pre_tokenizer"].get("add_prefix_space")
        self._cut = self._cut and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in pre.get("added_tokens", []))
        # bytes of each id: a byte-level vocabulary spells a byte as a character, but for added tokens
        added = {t["id"]: len(t["content"].encode()) for t in pre.get("added_tokens", [])}
        self._bytes = np.zeros(self._model.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self._model.get_vocab(with_added_tokens=True).items():
            self._bytes[i] = added.get(i, len(token))
        self._forget()

    def _forget(self) -> None:
        self._hash, self._row = np.zeros(0, T.U), np.zeros(0, np.int64)  # sorted hashes, and which row each is
        self._ids, self._text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self._id_at, self._text_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self._model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Those between white space are asked for as one text, whose ids part where the pieces do."""
        texts = [p.decode() for p in pieces]
        inner = [k for k, p in enumerate(texts) if p and p[0] in _WHITE and p[-1] not in _WHITE]
        out: list = [None] * len(pieces)
        if inner:
            ids = self._ask(["".join([texts[k] for k in inner])])[0]
            ends, stops = np.cumsum(self._bytes[ids]), np.cumsum([len(pieces[k]) for k in inner])
            parts = np.searchsorted(ends, stops)
            if ends[-1] != stops[-1] or (ends[parts] != stops).any():
                raise ValueError("a token spans white space: this vocabulary can't be cut there")
            for k, part in zip(inner, np.split(ids, parts[:-1] + 1), strict=True):
                out[k] = part
        rest = [k for k, x in enumerate(out) if x is None]
        for k, part in zip(rest, self._ask([texts[k] for k in rest]), strict=True):
            out[k] = part
        return out

    def _learn(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> None:
        data = raw.tobytes()
        ids = self._encode([data[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        self._ids = np.concatenate([self._ids, *ids])
        self._text = np.concatenate([self._text, raw[_spread_out(start, size)]])
        first = len(self._id_at) - 1
        self._id_at = np.concatenate([self._id_at, self._id_at[-1] + np.cumsum([len(x) for x in ids])])
        self._text_at = np.concatenate([self._text_at, self._text_at[-1] + np.cumsum(size)])
        self._hash = np.concatenate([self._hash, h])
        self._row = np.concatenate([self._row, np.arange(first, first + len(h))])
        order = np.argsort(self._hash, kind="stable")
        self._hash, self._row = self._hash[order], self._row[order]

    def _find(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The remembered row of each piece; -1 where there is none of the same bytes."""
        if not len(self._hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self._hash, h), len(self._hash) - 1)
        row = np.where(self._hash[at] == h, self._row[at], -1)
        some = np.flatnonzero(row >= 0)
        some = some[np.diff(self._text_at)[row[some]] == size[some]]
        some = some[_alike(raw, start[some], self._text, self._text_at[row[some]], size[some])]
        out = np.full(len(h), -1)
        out[some] = row[some]
        return out

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts raw[offsets[k] : offsets[k + 1]], and how many each has."""
        if not self._cut:
            data = raw.tobytes()
            ids = self._ask([data[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)
        cuts = cuts_of(raw, offsets)
        start, size = cuts[:-1], np.diff(cuts)
        n = len(raw)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, T.U)
            np.cumsum(T._BYTE[0][raw] * T.powers(int(T._P), n)[:n], out=sums[1:])
            h = T.mix((sums[cuts[1:]] - sums[start]) * T.powers(T.inverse(int(T._P)), n)[start])
        kept = size <= LONGEST
        if len(self._row) > REMEMBERED:
            self._forget()
        one, back = np.unique(h[kept], return_index=True, return_inverse=True)[1:]
        first = np.flatnonzero(kept)[one]
        unknown = first[self._find(raw, start[first], size[first], h[first]) < 0]
        if len(unknown):
            self._learn(raw, start[unknown], size[unknown], h[unknown])
        row = np.full(len(h), -1)
        row[kept] = self._find(raw, start[first], size[first], h[first])[back]
        # pieces of a batch that share a hash must share their bytes, too
        same = first[back]
        mine = np.flatnonzero(kept)
        odd = size[mine] != size[same]
        pairs = np.flatnonzero(~odd & (mine != same))
        odd[pairs[~_alike(raw, start[mine[pairs]], raw, start[same[pairs]], size[mine[pairs]])]] = True
        row[mine[odd]] = -1
        # long pieces, and what only a hash would take for known, are asked for each time
        alone = np.flatnonzero(row < 0)
        data = raw.tobytes() if len(alone) else b""
        extra = self._encode([data[a : a + k] for a, k in zip(start[alone].tolist(), size[alone].tolist(), strict=True)])
        at = np.where(row >= 0, self._id_at[row], 0)
        count = np.where(row >= 0, np.diff(self._id_at, append=self._id_at[-1])[row], 0)
        at[alone] = len(self._ids) + np.cumsum([0, *[len(x) for x in extra]])[:-1]
        count[alone] = [len(x) for x in extra]
        ids = (np.concatenate([self._ids, *extra]) if len(alone) else self._ids)[_spread_out(at, count)]
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(cuts, offsets)])

    def __call__(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.batch(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes() if len(raw) else b""


@lru_cache(1)
def _encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a worker, which go on with what it remembers."""
    return Encoder(vocabulary)


def _write(where: str, vocabulary: str, shard: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(where)
        encode = _encoder(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, sizes, held, size, seq
            name = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.wm"
            data = pack(np.concatenate(held), np.asarray(docs, np.int64), np.asarray(sizes, np.int64))
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            row = [[part], [seq], [name], [len(docs)], [size], [len(data)]]
            docs, sizes, held, size, seq = [], [], [], 0, seq + 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "file", "docs", "tokens", "bytes"])

        for batch in batches:
            ids = T.id_array(batch.column("id")).tolist()
            for i, j, raw, off in T.parts(batch.column("text"), CHUNK):
                tokens, counts = encode.batch(raw, off)
                # the end id behind each document's own
                ends = np.cumsum(counts)
                tokens = np.insert(tokens, ends, END)
                ends = np.concatenate([[0], ends + np.arange(1, j - i + 1)])
                for k in range(j - i):
                    n = int(ends[k + 1] - ends[k])
                    if size and size + n > shard:
                        yield flush()
                    docs.append(ids[i + k])
                    sizes.append(n)
                    held.append(tokens[ends[k] : ends[k + 1]])
                    size += n
        if docs:
            yield flush()

    return write


def write_tokens(docs: DataFrame, where: str, vocabulary: str | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` into shard files under ``where`` (a folder that all executors share) and returns their manifest.

    The manifest has part, seq (shards in ascending order of ids), file, docs, tokens, bytes and is kept as Parquet in
    ``where``/manifest, too. Null text counts as empty, so such a document is its end id alone; rows without an id are left out; rows that repeat an id are
    documents of their own, one after another. An id that fills a third of the table is dealt by its texts and rows. No rows, no shards. Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    order = [F.col("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions("id", F.xxhash64("text")).select("id", "text")
    fs, root = pa.fs.FileSystem.from_uri(where)
    fs.create_dir(root, recursive=True)
    made = ranged.mapInArrow(_write(where, vocabulary or default_vocabulary(), shard), _MANIFEST)
    made.write.mode("overwrite").parquet(f"{where}/manifest")
    return manifest(spark, where)


def manifest(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{where}/manifest")


def _dealt(spark: SparkSession, where: str) -> DataFrame:
    """file, start (ids of all shards before): a shard a row and, up to 20,000 shards, a task. The window's one task sees a row a shard."""
    shards = manifest(spark, where)
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.repartition(min(max(shards.count(), 1), 20_000), "file")


def _each(where: str, use):
    """use(shard, start) -> record batches, for each shard of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(where)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    yield from use(Shard(f), start)

    return run


def read_digests(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), read from the files."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        raw = memoryview(shard.all().astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
        yield pa.record_batch([pa.array(shard.docs), pa.array(start + shard.starts[:-1]), pa.array(shard.lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(spark, where).mapInArrow(_each(where, use), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, ids (array of int, with the end id), read from the files."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        ids = shard.all().astype(np.int32)
        for i, j in T.chunks(shard.starts, 1 << 18):
            part = pa.ListArray.from_arrays(pa.array((shard.starts[i : j + 1] - shard.starts[i]).astype(np.int32)), pa.array(ids[shard.starts[i] : shard.starts[j]]))
            yield pa.record_batch([pa.array(shard.docs[i:j]), pa.array(start + shard.starts[i:j]), part], names=["doc_id", "start", "ids"])

    return _dealt(spark, where).mapInArrow(_each(where, use), "doc_id long, start long, ids array<int>")


def token_counts(spark: SparkSession, where: str, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each of ``tokens`` in all shards, by rank alone."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _dealt(spark, where).mapInArrow(_each(where, use), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, where: str, tokens: list[int]) -> DataFrame:
    """token, doc_id, position (in the document): where each of ``tokens`` occurs, by select alone."""

    def use(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        for t in tokens:
            found = np.fromiter(shard.locate(t), np.int64)
            if len(found):
                d = np.searchsorted(shard.starts, found, "right") - 1
                yield pa.record_batch([pa.array(np.full(len(found), t)), pa.array(shard.docs[d]), pa.array(found - shard.starts[d])], names=["token", "doc_id", "position"])

    return _dealt(spark, where).mapInArrow(_each(where, use), "token long, doc_id long, position long")


def token_files(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids to shard files in the shared folder, and gives each document's digest as the files have it."""
    where = folder(docs.sparkSession, "tokens")
    write_tokens(docs, where, vocabulary, id_col=id_col, text_col=text_col)
    return settle(read_digests(docs.sparkSession, where).withColumnRenamed("doc_id", id_col), "digests")
