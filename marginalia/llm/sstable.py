"""Token-id output as sorted-string-table shards.

Layout of a shard, all numbers little-endian:

    block*   entries sorted by key: varint shared, varint unshared, varint
             value bytes, key suffix, value; the first entry of a block holds
             its whole key
    index    per block: u16 key bytes, first key, u64 offset, u32 bytes
    bloom    bit array, ``BLOOM_HASHES`` bits to a key
    footer   ``FOOTER`` below: where index and bloom are, counts, id width

Keys order like the identifiers: a byte 0 for null, else a byte 1 and the
64-bit big-endian value with its sign bit flipped.  A value is the ids of one
document with the end id, 2 bytes each where the vocabulary fits, else 4.

Documents are dealt out by ranges of doc_id and the start of the text, and sorted, so that shards follow
each other; each task streams its rows into one file of a name of its own.  Only files
in the shard list, which Spark commits task by task, count, so a repeated or speculative task does no
harm and no file is ever renamed or overwritten; a task that fails removes its own.  The list has the range
of identifiers of each shard, so that ``lookup`` opens only those that can hold one.
The files are written through the file system of the shared folder.

Defined results.  Null text counts as empty: just the end id.  Null doc_id sorts
first.  Repeated doc_id values keep one entry each; their order among
themselves follows the text; those with the same first ``DEALT`` characters stand in one shard.  Texts of
any length are encoded whole.  An empty table gives no shards and no rows.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import fresh_path, give_back, staged

BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"MGSST001"
FOOTER = struct.Struct("<QQQQQQH6x8s")
END_ID = 0
#: Characters of a text that, after doc_id, decide on its shard.
DEALT = 64
#: Distinct chunks remembered by an encoder, about 200 bytes each: half of them new ones, half those before.
CACHE_CHUNKS = 400_000
#: Chunks encoded as one text.
JOINED_CHUNKS = 512
#: Bytes of texts whose chunks are numbered together (more for a longer text), and texts whose ids are gathered at once.
TOGETHER, GATHERED = 16 << 20, 512
_LATIN, _MARKS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@[-`{-~"
#: Latin letters, digits, marks but the apostrophe, and single line ends between them.
PLAIN = re.compile(rf"[{_LATIN}0-9{_MARKS}]+(?:\n[{_LATIN}0-9{_MARKS}]+)*")


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary, by byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


BYTE_LETTERS = _byte_letters()


def _plain_kinds() -> dict[str, str]:
    """The kind of each character of a vocabulary that stands for a byte of plain chunks behind a space each."""
    out = {BYTE_LETTERS[32]: "space", BYTE_LETTERS[10]: "line"}
    for b in range(33, 256):
        if b > 127:
            # First bytes of U+00C0 to U+024F, and bytes that follow.
            if b < 0xC0 or 0xC3 <= b <= 0xC9:
                out[BYTE_LETTERS[b]] = "letter"
        elif PLAIN.fullmatch(chr(b)):
            out[BYTE_LETTERS[b]] = "letter" if chr(b).isalpha() else "digit" if chr(b).isdigit() else "mark"
    return out


def _keeps_apart(merges: list) -> bool:
    """Whether no merge joins what the usual pattern of a byte-level BPE cuts in plain chunks behind a space each:
    letters, digits, marks and line ends from each other, and anything from a space behind it."""
    kinds = _plain_kinds()
    for merge in merges:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if all(x in kinds for x in a + b):
            x, y = kinds[a[-1]], kinds[b[0]]
            # Neither two spaces nor a space beside a line end occur.
            if x != y and x != "space" and (x, y) != ("line", "space"):
                return False
    return True


def _plain_tokenizer(tok):
    """tok for plain chunks, written in the characters of its vocabulary, without its pattern, which its merges make
    needless, and its mapping of bytes; None where tok has other parts than those of a byte-level BPE."""
    from tokenizers import Tokenizer

    parts = json.loads(tok.to_str())
    kind, model = parts["pre_tokenizer"] or {}, parts["model"]
    usual = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    other = ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")
    if not usual or parts["normalizer"] or model["type"] != "BPE" or any(map(model.get, other)) or not _keeps_apart(model["merges"]):
        return None
    return Tokenizer(tok.model)


def _slices(texts) -> Iterator:
    """Parts of an Arrow array of texts of about TOGETHER bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


class ChunkEncoder:
    """Encodes texts with a tokenizer, remembering the ids of chunks.

    For a byte-level BPE that splits before a space followed by a non-space, a
    text may be cut at each such space and the parts encoded apart.  Texts in
    which another space occurs (beside white space or at the end), or that hold
    a special token, go to the tokenizer whole.

    Arrow cuts the texts and numbers their distinct chunks, so that only these become Python's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Chunks come once, so the tokenizer's own memory of words only costs time.
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: Whether the token of an id begins with a space.
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for x, i in self.tok.get_vocab().items() if x.startswith(BYTE_LETTERS[32])]] = True
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}
        #: The tail before this one; what is met again moves on.
        self.old: dict[str, bytes] = {}
        self.plain_tok = _plain_tokenizer(self.tok)

    def _pack(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        out = [array(code, e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in out:
                ids.byteswap()
        return [ids.tobytes() for ids in out]

    def _pack_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a space each."""
        plain = [] if self.plain_tok is None else list(filter(PLAIN.fullmatch, chunks))
        if len(plain) == len(chunks):
            return self._pack_joined(self.plain_tok, chunks)
        found = dict(zip(plain, self._pack_joined(self.plain_tok, plain), strict=True))
        others = [x for x in chunks if x not in found]
        found.update(zip(others, self._pack_joined(self.tok, others), strict=True))
        return [found[x] for x in chunks]

    def _pack_joined(self, tok, chunks: list[str]) -> list[bytes]:
        """Many are encoded as one text, which saves a call per chunk, and told apart by the tokens that begin
        with a space."""
        out: list[bytes] = []
        for lo in range(0, len(chunks), JOINED_CHUNKS):
            part = chunks[lo : lo + JOINED_CHUNKS]
            text = " " + " ".join(part)
            if tok is self.plain_tok:
                text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(part) or at[0]:
                out += self._pack([" " + x for x in part])
                continue
            raw, w = ids.tobytes(), self.dtype.itemsize
            edges = [*(at * w).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def __call__(self, texts) -> list[bytes]:
        """The ids of texts, a list or an Arrow array; null counts as empty."""
        import pyarrow as pa

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [ids for _, part in _slices(texts) for ids in self._encode(part)]

    def _encode(self, texts) -> list[bytes]:
        import pyarrow.compute as pc

        if len(self.tail) + len(self.head) > CACHE_CHUNKS // 2:
            self.head.clear()
            self.old, self.tail = self.tail, {}
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        first = parts.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        numbered = parts.flatten().dictionary_encode()
        number, chunks = numbered.indices.to_numpy().copy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [chunks[k] for k in number[first[:-1]].tolist()]
        missing = list(set(heads).difference(self.head))
        self.head.update(zip(missing, self._pack(missing), strict=True))
        # Numbers beyond the chunks stand for the first parts of texts.
        number[first[:-1]] = len(chunks) + np.arange(len(heads))
        used = np.zeros(len(chunks) + len(heads), bool)
        used[number] = True
        ids = list(map(self.tail.get, chunks))
        missing = [k for k, x in enumerate(ids) if x is None]
        names = [chunks[k] for k in missing]
        known = list(map(self.old.get, names))
        for k, x, own in zip(missing, names, known, strict=True):
            if own is not None:
                self.tail[x] = ids[k] = own
        missing = [k for k, own in zip(missing, known, strict=True) if own is None]
        # Neither the empty chunk nor one that begins with white space lies behind a place to cut.
        odd = np.zeros(len(used), bool)
        odd[[k for k in missing if not chunks[k][:1].strip()]] = True
        fresh = np.array(missing, np.int64)
        fresh = fresh[used[fresh] & ~odd[fresh]].tolist()
        names = [chunks[k] for k in fresh]
        packed = self._pack_chunks(names)
        for k, x in zip(fresh, packed, strict=True):
            ids[k] = x
        if len(fresh) > CACHE_CHUNKS // 4:
            # Too many to remember for long: those met twice are likelier to be met again.
            often = np.bincount(number, minlength=len(used)) > 1
            fresh = np.array(fresh)[often[fresh]].tolist()
        self.tail.update((chunks[k], ids[k]) for k in fresh)
        ids = [x or b"" for x in ids]
        ids += [self.head[x] for x in heads]
        whole |= np.logical_or.reduceat(odd[number], first[:-1])
        # The ids of all chunks side by side; each text's are gathered from there.
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), self.dtype)
        out: list[bytes] = []
        for lo in range(0, len(texts), GATHERED):
            edges = first[lo : lo + GATHERED + 1]
            part = number[edges[0] : edges[-1]]
            each = size[part]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
            own = flat[np.arange(ends[-1]) + np.repeat(start[part] - ends[:-1], each)]
            edges = ends[edges - edges[0]].tolist()
            out += [own[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        again = np.flatnonzero(whole)
        for k, x in zip(again.tolist(), self._pack(texts.take(again).to_pylist()), strict=True):
            out[k] = x
        return out


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_spots(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key)
    b = zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b + i * i) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, which have to come in key order, to an output stream."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block = bytearray()
        self.first = self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.n = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.n += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for x in _bloom_spots(key, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.n, self.tokens, self.width, MAGIC))


class ShardReader:
    """Looks up and scans the entries of one shard."""

    def __init__(self, path: str):
        fs, local = _fs(path)
        self.file = fs.open_input_file(local)
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        at, n, bloom_at, self.bits, self.n, self.tokens, self.width, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.dtype = np.dtype(f"<u{self.width}")
        raw = self.file.read_at(n, at)
        self.bloom = self.file.read_at((self.bits + 7) // 8, bloom_at)
        self.index, spot = [], 0
        while spot < n:
            (k,) = struct.unpack_from("<H", raw, spot)
            key = raw[spot + 2 : spot + 2 + k]
            self.index.append((key, *struct.unpack_from("<QI", raw, spot + 2 + k)))
            spot += 14 + k
        self.firsts = [e[0] for e in self.index]

    def _block(self, entry: tuple[bytes, int, int]) -> Iterator[tuple[bytes, bytes]]:
        buf, at, key = self.file.read_at(entry[2], entry[1]), 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            fresh, at = _read_varint(buf, at)
            n, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + fresh]
            at += fresh
            yield key, buf[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for entry in self.index:
            for key, value in self._block(entry):
                yield decode_key(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = encode_key(doc_id)
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in _bloom_spots(key, self.bits)):
            return []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        out = []
        for entry in self.index[k:]:
            if entry[0] > key:
                break
            out += [np.frombuffer(v, self.dtype) for x, v in self._block(entry) if x == key]
        return out

    def close(self) -> None:
        self.file.close()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(tokenizer: str) -> ChunkEncoder:
    if tokenizer not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _ENCODERS[tokenizer] = ChunkEncoder(path)
    return _ENCODERS[tokenizer]


SHARD = "shard_no long, path string, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"


def write_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Write docs as shards; one row per shard: shard_no, path, n_docs, n_tokens, first_id and last_id (the
    least and largest doc_id, null where all are), has_null, and start, the number of ids in the shards before it.

    tokenizer is a file of the public tokenizers, or a path that all executors
    can open.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sst")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        give_back()
        enc = _encoder(tokenizer)
        end = np.array([END_ID], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        fs, base = _fs(folder)
        writer = stream = None
        name, edges = f"shard-{part:07d}-{uuid.uuid4().hex[:12]}.sst", [None, None, False]
        try:
            for batch in batches:
                for lo, texts in _slices(batch.column(1)):
                    ids = batch.column(0).slice(lo, len(texts)).to_pylist()
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        stream = fs.open_output_stream(f"{base}/{name}")
                        writer = ShardWriter(stream, enc.dtype.itemsize)
                    for doc_id, value in zip(ids, enc(texts), strict=True):
                        writer.add(encode_key(doc_id), value + end)
                        if doc_id is None:
                            edges[2] = True
                        else:
                            edges[:2] = [doc_id if edges[0] is None else edges[0], doc_id]
            if writer is not None:
                writer.close()
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
                fs.delete_file(f"{base}/{name}")
            raise
        if writer is not None:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            row = (part, f"{folder}/{name}", writer.n, writer.tokens, *edges)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(by_id, F.substring("text", 1, DEALT)).sortWithinPartitions(by_id, "text")
    shards = staged(ordered.mapInArrow(write, SHARD), "shards")
    # One small row per shard: the only rows that this running total sees.
    before = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def lookup(shards: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of the documents with these identifiers; opens only the shards whose range holds one."""
    wanted = sorted({int(i) for i in doc_ids if i is not None})
    with_null = any(i is None for i in doc_ids)
    some = F.array(*[F.lit(i) for i in wanted]).cast("array<bigint>")
    inside = F.exists(some, lambda x: x.between(F.col("first_id"), F.col("last_id")))
    chosen = shards.where(F.coalesce(inside, F.lit(False)) | (F.col("has_null") & F.lit(with_null)))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                reader = ShardReader(path)
                found = [(i, x.tolist()) for i in [*wanted, *[None] * with_null] for x in reader.get(i)]
                reader.close()
                yield pd.DataFrame({"doc_id": pd.array([i for i, _ in found], "Int64"), "ids": [x for _, x in found]})

    return chosen.select("path").mapInPandas(read, "doc_id long, ids array<long>")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        import pandas as pd

        # All shards are written by now, and Spark keeps this worker for other stages.
        _ENCODERS.clear()
        give_back()
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                reader, rows = ShardReader(path), []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _frame(pd, rows)
                        rows = []
                reader.close()
                if rows:
                    yield _frame(pd, rows)

    # A fixed number, since an adaptive plan would gather the short list of paths in one task.
    width = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = shards.select("path", "start").repartition(width, F.col("path"))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(pd, rows):
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
    return out


def token_output(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    return read_shards(write_shards(docs, tokenizer))
