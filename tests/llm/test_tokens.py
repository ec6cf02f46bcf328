"""Encoding, decoding and packing against the tokenizer library."""
import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lanewise.llm import byte_bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a", "Hello world, it's  two  spaces\n\n\tand\ttabs ", "don't we'll I'm they've", "x" * 5000, "ab " * 3000, "日本語のテキスト と 中文", "naïve café ﬁ ß Ω",
         "a<|endoftext|>b  <|endoftext|> c", "1234567 12.5% $$$ ###", "\x1c\x1d mixed \x1f separators\x85next line end", "tab\t\t x \r\n y", "🙂🙃 emoji👩‍👩‍👧", "   leading", "trailing   ",
         "don’t ‘quote’ — dash…", "\x01\x02", "'s's 'S 're"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_trie_equals_library_on_edge_cases_and_random_texts():
    enc, other = byte_bpe.ChunkEncoder(PATH), packing.LibraryEncoder(PATH)
    rng = random.Random(3)
    made = ["".join(rng.choice("aeinrst thABZ0189 .,'\n-éß語") for _ in range(rng.randrange(200))) for _ in range(300)]
    for e in (enc, other):
        for text, ids in zip(TEXTS + made, e.encode(TEXTS + made)):
            assert np.frombuffer(ids, "<u4").tolist() == expected(text), repr(text)
            assert e.decode(ids) == text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 1000)
    enc = byte_bpe.ChunkEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(TEXTS)] == [expected(t) for t in TEXTS]


def test_encode_and_decode_rows(documents):
    docs = documents((1, None), (2, ""), (3, TEXTS[3]), (3, TEXTS[3]), (None, "x")).withColumnRenamed("lang", "ids")
    got = {(r.doc_id, bytes(r.ids), r.decoded) for r in byte_bpe.encode(docs, PATH, decoded=True).collect()}
    assert got == {(i, np.array(expected(t), "<u4").tobytes(), t or "") for i, t in ((1, None), (2, ""), (3, TEXTS[3]), (None, "x"))}
    assert byte_bpe.encode(docs, PATH).count() == 5
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted([(1, ""), (2, ""), (3, TEXTS[3]), (3, TEXTS[3]), (0, "x")])
    assert byte_bpe.encode(docs.limit(0), PATH).count() == 0


def check_pieces(rows, docs, length):
    ids = {}
    for i, text in docs:
        ids.setdefault(i, np.array([*expected(text), 0], "<u4"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and 0 < r.length <= length
        assert zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == zlib.crc32(bytes(r.ids))
    assert pieces.keys() == ids.keys()
    for i, got in pieces.items():
        at = 0
        for start, n in sorted(got):
            assert start == at
            at += n
        assert at == len(ids[i])
    places = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert sorted(places) == list(range(len(places)))
    assert all(v == length for k, v in places.items() if k != len(places) - 1)


def test_packing_is_gapless_and_holds_the_mixture(documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(60))), "en", f"s{min(3, i % 6)}") for i in range(240)]
    rows += [(900, None, "en", None), (901, "", "en", "rare"), (902, "word " * 700, "en", "s3")]
    out = packing.pack(documents(*rows).repartition(5), PATH, length=32, window=4).collect()
    check_pieces(out, [r[:2] for r in rows], 32)
    share, source = {}, {r[0]: r[3] for r in rows}
    for r in out:
        share.setdefault(r.window, {}).setdefault(source[r.doc_id], []).append(r.length)
    whole = {s: sum(sum(w.get(s, [])) for w in share.values()) / len(share) for s in set(source.values())}
    for w in share.values():
        assert all(abs(sum(w.get(s, [])) - n) <= 1.01 for s, n in whole.items())


def test_targets_hold_until_a_queue_is_dry(documents):
    rows = [(i, "alpha beta gamma delta " * 8, "en", "ab"[i % 2]) for i in range(80)]
    out = packing.pack(documents(*rows), PATH, length=16, window=4, targets={"a": 3.0, "b": 1.0}).collect()
    check_pieces(out, [r[:2] for r in rows], 16)
    first = [r for r in out if r.window < 10]
    a = sum(r.length for r in first if r.doc_id % 2 == 0)
    assert a / sum(r.length for r in first) == pytest.approx(0.75, abs=0.03)


def test_empty_table_packs_to_nothing(documents):
    assert packing.pack(documents((1, "x")).limit(0), PATH).count() == 0


def test_neighbours_that_stay_apart():
    """Undoing merges from the last one back says the same as merging anew."""
    v = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    trie, rng = byte_bpe.TrieEncoder(v), random.Random(3)
    short = [i for i, t in v.tokens.items() if len(t) <= 3 and i in v.made]
    apart = 0
    for k in range(4000):
        a, b = rng.choice(short), rng.choice(short if k % 3 else list(v.made))
        want = v.merged(v.tokens[a] + v.tokens[b]) == [a, b]
        assert trie.stays_apart(a, b) == want
        apart += want
    assert 0 < apart < 4000


def test_a_vocabulary_with_two_ways_to_a_token(tmp_path):
    """abc is made of a and bc, and of ab and c; the tables say so and merging itself decides."""
    tokens = [*sorted(byte_bpe.byte_of(), key=byte_bpe.byte_of().get), "bc", "ab", "abc"]
    spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": ["b c", "a bc", "a b", "ab c"]}, "added_tokens": []}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    v = byte_bpe.Vocabulary(str(tmp_path / "v.json"))
    words = {bytes(w, "ascii") for n in range(1, 7) for w in map("".join, itertools.product("abc", repeat=n))}
    assert v.unclear == {v.ids[b"abc"]}
    assert byte_bpe.TrieEncoder(v).encode(words) == {w: v.merged(w) for w in words}
