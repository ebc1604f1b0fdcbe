"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import frames
from tillstone.llm import bpe, common, simple8b


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark, library):
    got = sorted(bpe.digests(frames.docs(spark)).collect(), key=frames.key)
    expected = []
    for doc_id, text, *_ in frames.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert [tuple(r) for r in got] == sorted(expected, key=frames.key)
    assert bpe.digests(frames.empty(spark)).count() == 0


def test_encode_then_decode(spark, library):
    ids = bpe.encode(frames.docs(spark))
    back = {r["id"]: r["text"] for r in bpe.decode(ids).collect()}
    for doc_id, text, *_ in frames.rows():
        if doc_id is not None:
            assert back[doc_id] == library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_odd_texts_and_long_words(library):
    own, rnd = bpe.Codec(open(bpe.VOCABULARY, encoding="utf-8").read()), random.Random(1)
    letters = "aBc é́ͅ  ΣσΑς'sLLREve <|endoftext|><|startoftext|>\n\t日本1२ß!!!😀İẞ\x1c\x85 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["ab" * 3000, "thering" * 100, "!" * 700, "the's<|endoftext|>'ll"]
    flat, sizes = own.encode([t.encode() for t in texts])
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for text, got, wanted in zip(texts, parts, library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == wanted.ids
        assert own.decode(got.tolist()) == library.decode(wanted.ids, skip_special_tokens=False)


def test_pack_and_unpack():
    rnd = random.Random(2)
    for k in range(60):
        values = np.array([rnd.getrandbits(rnd.choice([1, 3, 16, rnd.randint(1, 64)])) if rnd.random() < 0.9 else 0 for _ in range(rnd.choice([0, 1, 5, 4096, 4097, 9000]))], np.uint64)
        block = simple8b.pack(values)
        assert (simple8b.unpack(block) == values).all()
        for group in range(-(-len(values) // simple8b.GROUP)):
            assert (simple8b.unpack(block, group) == values[group * simple8b.GROUP:(group + 1) * simple8b.GROUP]).all()
    ids = np.random.default_rng(1).integers(0, 1 << 15, 40_000).astype(np.uint64)
    assert len(simple8b.pack(ids)) < 2.1 * len(ids)  # four ids of 15 bits to a word


def test_token_file(spark, library):
    got = [tuple(r) for r in simple8b.round_trip(frames.docs(spark)).orderBy("start").collect()]
    expected, start = [], 0
    for doc_id, text, *_ in sorted(frames.rows(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert simple8b.round_trip(frames.empty(spark)).count() == 0


def test_words_of_letters_go_to_the_model_alone(library):
    spec = open(simple8b.VOCABULARY, encoding="utf-8").read()
    assert simple8b._letters_alone(library)
    more = Tokenizer.from_str(spec)
    more.add_special_tokens(["stop"])  # a token inside words of letters: the library has to look for it
    assert not simple8b._letters_alone(more)
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcXYZst's.é<|1 \0"[:rnd.choice([6, 8, 18])]) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    words = [w for w in " ".join(words).split(" ") if w] + ["STOP", "unstoppable", "Ab" * 3000, "<|endoftext|>"]
    for name, own in (("plain", library), ("more", more)):
        flat, sizes = simple8b._encoder(f"test {name}", own.to_str()).values([w.encode() for w in words])
        for word, got in zip(words, np.split(flat, np.cumsum(sizes)[:-1])):
            assert got.tolist() == own.encode(word, add_special_tokens=False).ids, word


def test_plain_words_go_to_the_model_in_pieces(library, monkeypatch):
    spec, calls = open(simple8b.VOCABULARY, encoding="utf-8").read(), []

    class Counted:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return self.own.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(simple8b, "Tokenizer", type("T", (), {"from_str": staticmethod(lambda x: Counted(Tokenizer.from_str(x)))}))
    monkeypatch.setattr(simple8b, "KEPT_PIECES", 500)
    latin = "".join(chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)] if chr(c) not in "'\u00D7\u00F7")
    rnd = random.Random(11)
    plain = [*latin, *(a + b for a in latin for b in "aZ\u00E9\u00DF7.<|"), *("".join(rnd.choice(latin[:rnd.choice([60, 92, len(latin)])]) for _ in range(rnd.randint(2, 20))) for _ in range(3000))]
    odd = ["it's", "<|endoftext|>", "x<|EndOfText|>y", "\u00D7", "\u00F7a", "\u00B5m", "1\u00B2", "e\u0301", "\u0130x", "\u03A3\u0391\u03A3", "a\x7fb", "\xad", "\u4E2D1a", "a\0b"]
    encoder = simple8b._encoder("test pieces", spec)
    asked = len(calls)
    for words in (plain, odd + plain[:50] + odd):
        flat, sizes = encoder.make([w.encode() for w in words])
        for word, got in zip(words, np.split(flat, np.cumsum(sizes)[:-1])):
            assert got.tolist() == library.encode(word, add_special_tokens=False).ids, word
        if words is plain:
            assert len(calls) == asked  # the library cut none of them


def test_words_of_a_block_take_all_they_can():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 7, 119, 120, 121, 300, 1000):
        for top in (1, 2, 3, 8, 16, 40, 64):
            bits = rnd.integers(0, top + 1, n).astype(np.uint8) * (rnd.random(n) < rnd.choice([0.02, 0.5, 1]))
            end, selector = simple8b._plan(bits, 128)
            widest = int(bits.max())
            for p in range(n):
                fit = [at for at, (count, width) in enumerate(simple8b.MODES, 1) if width >= widest or p + count <= n and bits[p:p + count].max() <= width]
                at = min(fit, default=0)
                assert selector[p] == at and end[p] == min(p + simple8b._COUNTS[at], (p // 128 + 1) * 128, n)


def test_ids_are_read_back(spark, library):
    folder = common.shared_path(spark, "test")
    simple8b.write_token_file(frames.docs(spark), folder)
    for row in simple8b.read_token_file(spark, folder).where("doc_id is not null").collect():
        text = next(t for d, t, *_ in frames.rows() if d == row["doc_id"])
        assert row["ids"] == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_are_let_go_at_the_limit():
    cache = common.WordCache(lambda words: [list(w) for w in words], limit=10)
    for i in range(50):
        words = [b"w%d" % (i + k) for k in range(7)]
        flat, sizes = cache.values(words)
        assert bytes(flat.tolist()) == b"".join(words) and sizes.tolist() == [len(w) for w in words]
    assert len(cache.known) < 30
