import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from ondaframe.llm import parts, trie_bpe, vector_packing, vlc_ids
from ondaframe.llm.chunked import ChunkEncoder
from ondaframe.llm.trie_bpe import TrieBPE

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "x<|endoftext|> y  <|endoftext|>z", "\x1c a \x1cb", "é" * 3000, "　 x\xa0y   z", "b́ c ́d", "t\t\tx \t\r\n\r\n z", "it's we'll 've", "a.b, c., d.", "\U0001f600 ok \x00"]


def fuzz(n=3000):
    rnd = random.Random(5)
    letters = [*"ab 'sT12é\n\t  　\xa0.,!<|>", "<|endoftext|>", "ll", "\x1c", "\x85", "<|startoftext|>"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def ids(lib, texts):
    return [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_parts_encode_as_the_library():
    texts = ODD + fuzz()
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        truth = ids(Tokenizer.from_file(path), texts)
        enc = ChunkEncoder(path, kind, room=50)
        got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 100) for x in enc.encode(texts[at : at + 100])]
        assert got == truth
        assert ChunkEncoder(path, kind).encode([None, ""]) == [b"", b""]


def test_plain_words_go_as_one_text():
    """Only words of other than Latin letters are pre-split; letters that are two or gone after lower-casing too."""
    enc, seen = ChunkEncoder(WORD, "word"), []
    by_word = enc._by_word
    enc._by_word = lambda parts: seen.extend(parts) or by_word(parts)
    plain = [f"{a}{b}{c}" for a in ("Wort", "été", "ÀÉÎ", "ŷß", "łŁ") for b in "abcdefgh" for c in ("", "S", "ñ")]
    odd = ["don't", "a1", "漢字", "x-y", "ſt", "K", "日", "!!", "e\u0301"]
    other = ["İstanbul", "aİb", "İİ"]
    for words in (plain + odd, plain + odd + other):
        texts = [" ".join(words), " ".join(reversed(words))]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == ids(Tokenizer.from_file(WORD), texts)
        if words[-1] == odd[-1]:
            assert not {*seen} & {*plain} and {"don't", "漢字"} <= {*seen}
        enc.cache.clear()


def test_parts_are_looked_up_once_for_many_texts():
    enc = ChunkEncoder(BYTE, "byte")

    class Counted(dict):
        n = 0

        def get(self, *x):
            Counted.n += 1
            return super().get(*x)

        def __getitem__(self, x):
            Counted.n += 1
            return super().__getitem__(x)

    enc.cache = Counted()
    texts = ["one two three one two three " * 100 + str(k) for k in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == ids(Tokenizer.from_file(BYTE), texts)
    assert Counted.n < 300  # of 30,000 parts 54 are different


def test_trie_encodes_and_decodes_as_the_library():
    texts = ODD + fuzz()
    lib, bpe = Tokenizer.from_file(BYTE), TrieBPE(BYTE)
    truth = ids(lib, texts)
    got = bpe.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == truth
    assert [bpe.decode(x) for x in got] == [lib.decode(t, skip_special_tokens=False) for t in truth]


def test_trie_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in trie_bpe.encode_documents(docs, BYTE).collect()}
    lib = Tokenizer.from_file(BYTE)
    for r in docs.collect():
        t = lib.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(t)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.asarray(t, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_trie_on_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (3, "x" * 200_000, 7), (None, "a\n\nb\nc", 8), (4, "one two", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    lib = Tokenizer.from_file(BYTE)
    want = sorted((d or 0, len(t), hashlib.sha256(np.asarray(t, "<u4").tobytes()).hexdigest()) for d, t in ((d, lib.encode(x or "", add_special_tokens=False).ids) for d, x, _ in rows))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in trie_bpe.encode_documents(docs, BYTE).collect()) == want
    plain = {r.doc_id: r.decoded for r in trie_bpe.encode_documents(docs, BYTE, digests=False).collect()}
    assert plain[None] == "a\n\nb\nc" and plain[1] == ""
    assert trie_bpe.encode_documents(docs.limit(0), BYTE).count() == 0


def test_best_fit_is_by_dot_product():
    limits = vector_packing.Limits(100, 8, 40)
    packer, rnd = vector_packing.Packer(limits, window=40, cut=False), random.Random(4)
    waiting = [(k, n, rnd.randint(0, min(n, 40))) for k, n in enumerate(rnd.sample(range(1, 61), 39))]
    bins, plain = [], []
    for k, n, loss in waiting:
        bins += packer.add(k, n, loss)
    bins += packer.end()
    while waiting:  # the same, one comparison at a time
        free, out = [100, 8, 40], []
        while True:
            fits = [x for x in waiting if x[1] <= free[0] and 1 <= free[1] and x[2] <= free[2]]
            if not fits:
                break
            score = lambda x: x[1] * free[0] / 100**2 + free[1] / 8**2 + x[2] * free[2] / 40**2
            best = max(fits, key=score)
            waiting.remove(best)
            out.append((best[0], round(score(best), 9)))
            free = [free[0] - best[1], free[1] - 1, free[2] - best[2]]
        plain.append(out)
    assert [[x[0] for x in b] for b in bins] == [[k for k, _ in b] for b in plain]


def test_block_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        assert (vlc_ids.decode_block(vlc_ids.encode_block(v)) == v).all()
    assert vlc_ids.encode_block(np.array([1, 300, 70000, 1 << 24])).hex() == "46564231" + "04000000" + "e4" + "01" + "2c01" + "701101" + "00000001"


def test_ids_of_documents_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(5, "b c", 1), (3, None, 2), (5, "a", 3), (9, "", 4), (None, "x", 5)], "doc_id bigint, text string, part int")
    got = vlc_ids.corpus_ids(docs, BYTE).orderBy("start").collect()
    lib = Tokenizer.from_file(BYTE)
    order = [(None, "x"), (3, ""), *sorted(((5, "b c"), (5, "a")), key=lambda d: np.asarray(ids(lib, [d[1]])[0] + [2], "<u2").tobytes()), (9, "")]
    at = 0
    for r, (doc, text) in zip(got, order, strict=True):
        t = ids(lib, [text])[0] + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(t), zlib.crc32(np.asarray(t, "<u4").tobytes()))
        at += len(t)
    assert vlc_ids.corpus_ids(docs.limit(0), BYTE).count() == 0


def check_packed(rows, texts, limit=2048, segments=128):
    lib = Tokenizer.from_file(WORD)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        t = np.asarray(lib.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(t) // 4
            assert p.ids_crc32 == zlib.crc32(t[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(t) // 4
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit and at & (at - 1) == 0 and len(pieces) <= segments


def test_documents_are_packed_without_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packed(vector_packing.pack_documents(docs.repartition(3), WORD).collect(), {r.doc_id: r.text for r in docs.collect()})
    few = spark.createDataFrame([(i, None if i % 3 else "tiny text", i) for i in range(700)], "doc_id bigint, text string, length int")
    check_packed(vector_packing.pack_documents(few, WORD).collect(), {r.doc_id: r.text for r in few.collect()})
    assert vector_packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_loss_limit_holds_when_cutting():
    limits = vector_packing.Limits(64, 4, 20)
    packer, rnd, bins = vector_packing.Packer(limits, window=16), random.Random(2), []
    size = {}
    for k in range(200):
        mask = [rnd.random() < 0.3 for _ in range(rnd.randint(1, 150))]
        size[k] = len(mask)
        bins += packer.add(k, len(mask), np.concatenate([[0], np.cumsum(mask)]))
    bins += packer.end()
    got = {}
    for b in bins:
        assert sum(x[2] for x in b) <= 64 and len(b) <= 4 and sum(x[3] for x in b) <= 20
        for key, start, length, _ in b:
            got.setdefault(key, []).append((start, length))
    for k, n in size.items():
        at = 0
        for start, length in sorted(got[k]):
            assert start == at
            at += length
        assert at == n


def test_conversations_stay_whole_under_all_limits(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    limits = vector_packing.Limits(2048, 4, 600)
    rows = vector_packing.pack_conversations(turns, WORD, limits=limits).collect()
    assert len({r.conv_id for r in rows}) == len(rows) == turns.select("conv_id").distinct().count()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for x in by_seq.values():
        assert len(x) == 1 or (sum(r.tokens for r in x) <= 2048 and len(x) <= 4 and sum(r.loss for r in x) <= 600)
    assert len(by_seq) < len(rows)


def test_parts_of_a_batch_encode_as_the_library():
    """Also after parts were forgotten, in small slices and from the middle of a column."""
    texts = [*ODD, *fuzz(), None, "a.b c.\nd, é. ×, 5, x.", "a b 　c \nd  ", "q\0 \0q", "x" * 100_000, "one " * 1000]
    lib = Tokenizer.from_file(BYTE)
    truth = [t + [2] for t in ids(lib, [t or "" for t in texts])]
    for room, size in ((50, 300), (1000, 10_000), (100_000, 1 << 20)):
        enc, got = parts.PartEncoder(BYTE, 2, room), []
        for at, column, ends in enc.columns(pa.array(["before", *texts]).slice(1), size):
            assert at == len(got)
            flat, n = enc.encode_column(column, ends)
            got += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == truth
        assert enc.parts.n <= room + 10_000
    assert not [*enc.columns(pa.array([], pa.string()))]


def test_known_parts_do_not_go_to_the_library(monkeypatch):
    """Nor does a batch of known parts become a Python object a part."""
    texts = pa.array(["one two, three. " * 100 + "Four" for k in range(50)])
    enc = parts.PartEncoder(BYTE, 2)
    run = lambda: [enc.encode_column(column, ends)[0].tolist() for _, column, ends in enc.columns(texts)]
    first = run()
    monkeypatch.setattr(enc, "_add", None)
    assert run() == first
    monkeypatch.setattr(parts, "loaded", lambda path, end: enc)
    monkeypatch.setattr(vlc_ids, "loaded", None)
    [(at, flat, n)] = vlc_ids._encoded(texts, BYTE, "byte", 2, 256)
    assert (at, flat.tolist(), n.sum()) == (0, first[0], len(flat))


def test_parts_of_a_worker_are_bounded():
    """Frequent ones stay, long ones too."""
    enc = parts.PartEncoder(BYTE, 2, room=400)
    for k in range(40):
        texts = pa.array([" often the same andthesameagainandagain " + " ".join(f"w{k}x{i} along{'x' * 20}{k}x{i}" for i in range(60))])
        for _, column, ends in enc.columns(texts):
            enc.encode_column(column, ends)
        table = enc.parts
        assert table.n <= 600 and len(table.long) <= 200
        enc._encode_parts, put = None, enc._encode_parts
        for _, column, ends in enc.columns(pa.array([" often the same andthesameagainandagain"] if k else [])):
            enc.encode_column(column, ends)
        enc._encode_parts = put


def test_ids_of_words_by_rows():
    texts = pa.array([*ODD, None])
    got = [x.tolist() for _, flat, n in vlc_ids._encoded(texts, WORD, "word", 1, 4) for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [t + [1] for t in ids(Tokenizer.from_file(WORD), [t or "" for t in texts.to_pylist()])]
