import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import sstable as S
from tests.llm.helpers import docs_frame, odd_docs

TEXTS = ["Hello world, it's 12 o'clock.", "two  spaces and\ttab \n newline ", " lead", "trail ", "a b  c", "<|endoftext|> in text", "", "é😀 ü\n\nx", "   ", "don't  stop"]


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def test_chunked_encoding_is_exact():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = S.ChunkEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc(TEXTS)] == [ids_of(tok, t)[:-1] for t in TEXTS]


def test_a_chunk_met_in_every_batch_is_encoded_once(monkeypatch):
    monkeypatch.setattr(S, "CACHE_CHUNKS", 100)
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok, sent = S.ChunkEncoder(path), Tokenizer.from_file(path), []
    pack = enc._pack_chunks
    monkeypatch.setattr(enc, "_pack_chunks", lambda chunks: sent.extend(chunks) or pack(chunks))
    for k in range(30):
        text = "a common " + " ".join(f"w{k}x{i}" for i in range(20))
        assert np.frombuffer(enc([text])[0], enc.dtype).tolist() == ids_of(tok, text)[:-1]
    assert sent.count("common") == 1 and len(sent) == 601
    assert len(enc.tail) + len(enc.old) + len(enc.head) <= 150


def test_chunks_of_letters_are_encoded_without_the_pattern():
    """Their ids are those of the tokenizer, whatever letters and marks they have; its pattern sees only the others."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok, sent = S.ChunkEncoder(path), Tokenizer.from_file(path), []
    words = ["plain", "Straße", "éèê", "ÿ", "ɏx", "×", "µm", "ªº", "ŉ", "日本語", "ёж", "naïve.", "it's", "x1", "1x", "a_b", "Ǆ", "ﬁn", "e\u0301", "\u0250", "ab\ncd", "a\u00a0b", "\u0120x", "ACIÓN"]
    rng = random.Random(3)
    words += ["".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(0xA1, 0x260)])) for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    words += ["".join(chr(rng.randrange(97, 123)) for _ in range(6)) for _ in range(2000)]
    words += ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0xC0, 0x250)])) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(["x", *words]), " ".join(reversed(words))]
    class Seen:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(x for t in texts for x in t.split(" "))
            return tok.encode_batch_fast(texts, **kw)

    enc.tok = Seen()
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    # Texts of chunks at the border of the kinds hold some of both.
    assert sum(x.isascii() and x.isalpha() for x in set(sent)) < S.JOINED_CHUNKS < sum(x.isascii() and x.isalpha() for x in set(words))


def test_chunks_with_marks_digits_and_line_ends_are_encoded_without_the_pattern():
    """Their ids are those of the tokenizer; its pattern sees only chunks with an apostrophe, other white space or other letters."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok, sent = S.ChunkEncoder(path), Tokenizer.from_file(path), []
    rng = random.Random(4)
    signs = [chr(x) for x in range(33, 127) if x != 39]
    plain = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    plain += ["end.\nBegin", "café,\nÉté", "1,000.50%", "(x)", "a\nb\nc", "$$$", "...\n--"]
    plain += ["".join(rng.choice("abcdeéüß.,;!?#%019\n") for _ in range(rng.randrange(3, 14))).strip("\n").replace("\n\n", "\n") or "x" for _ in range(2000)]
    plain = [x for x in plain if S.PLAIN.fullmatch(x)]
    others = ["it's", "a\n\nb", "end\n", "a\tb", "日本", "a\r\nb", "×"]
    words = plain + others
    rng.shuffle(words)
    texts = [" ".join(["x", *words[k : k + 50]]) for k in range(0, len(words), 50)]

    class Seen:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    enc.tok = Seen()
    assert len(plain) > 3000
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert {x for t in sent for x in t.split(" ")} <= {"", "x", *others}


def test_merges_across_the_cuts_of_the_pattern_are_noticed():
    space, line = S.BYTE_LETTERS[32], S.BYTE_LETTERS[10]
    assert S._keeps_apart([["a", "b"], [space, "a"], [space, "."], "1 2", [".", ","], ["'", "s"], [line, space]])
    for merge in (["a", "."], ["1", "a"], [".", line], ["a", space], "a " + space + "b", [".", "Ã"]):
        assert not S._keeps_apart([merge])


def test_slices_and_many_chunks_give_the_same_ids(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = S.ChunkEncoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(S, "CACHE_CHUNKS", 40)
    monkeypatch.setattr(S, "TOGETHER", 500)
    monkeypatch.setattr(S, "GATHERED", 3)
    texts = [None, *TEXTS, *(" ".join(f"w{i * k % 97}" for k in range(i)) for i in range(60)), None]
    for _ in range(2):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc(texts)] == [ids_of(tok, t)[:-1] for t in texts]
    assert enc([]) == []


def test_round_trip_and_lookup(spark, tmp_path):
    rows = [(7 * i % 1000 - 300, f"text number {i} " + "x y z " * (i % 50)) for i in range(1000)] + [(5, None), (None, "no id"), (10**15, "far")]
    docs = docs_frame(spark, rows)
    shards = S.write_shards(docs, folder=str(tmp_path / "sst")).orderBy("shard_no").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(s["n_docs"] for s in shards) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids_of(tok, t))
    for doc_id in (-300, 5, 699, None, 10**15, 123_456):
        found = []
        for s in shards:
            reader = S.ShardReader(s["path"])
            found += [x.tolist() for x in reader.get(doc_id)]
            reader.close()
        assert sorted(found) == sorted(want.get(doc_id, []))
    got = sorted(S.token_output(docs).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    start = 0
    for r in got:
        assert r["start"] == start
        assert r["ids_crc32"] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want[r["doc_id"]]]
        start += r["n_tokens"]


def test_lookup_opens_only_shards_in_range(spark, tmp_path, monkeypatch):
    rows = [(i // 2, f"text {i}") for i in range(4000)] + [(None, "no id")]
    # All rows of one identifier, which ranges of doc_id alone can't part.
    rows += [(9999, f"{i:04d} hot") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = S.write_shards(docs_frame(spark, rows), folder=str(tmp_path / "sst")).cache()
        assert shards.count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.where("first_id <= 9999 and last_id >= 9999").count() >= 2
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"] or -1, r["ids"]) for r in S.lookup(shards, [7, None, 123_456]).collect())
    assert got == sorted([(-1, ids_of(tok, "no id")), (7, ids_of(tok, "text 14")), (7, ids_of(tok, "text 15"))])
    assert S.lookup(shards, [9999]).count() == 3000 and S.lookup(shards, []).count() == 0
    assert len(list((tmp_path / "sst").iterdir())) == shards.count()


def test_odd_rows(spark):
    rows = S.token_output(odd_docs(spark)).collect()
    assert len(rows) == 9 and sum(r["n_tokens"] == 1 for r in rows) == 3
    assert S.token_output(odd_docs(spark).where(F.lit(False))).count() == 0


def test_workers_that_read_let_go_of_the_encoder(spark, tmp_path, monkeypatch):
    shards = S.write_shards(docs_frame(spark, [(i, f"text {i}") for i in range(20)]), folder=str(tmp_path / "sst"))
    frame = shards.toPandas()
    monkeypatch.setattr(type(shards), "mapInPandas", lambda self, read, schema: read)
    read = S.read_shards(shards)
    S._encoder("byte_bpe_50k.json")
    assert sum(len(x) for x in read([frame])) == 20 and not S._ENCODERS
