"""The Python cores of the operators against the libraries and against plain versions, on adversarial texts."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import audio, dropout, packing, simhash, substrings, token_counts, warc
from lodestream.llm.queries import vocabulary

PARTS = ["a", "b", " ", "  ", "▁", "é", "x", "1", "\n", "😀", "́", ".", "the", "ing", "ß", "\x00", "中", "   ", "㍿", "<s>", "<0x0A>", "\t", ",", "Σ", "İ"]
texts = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_prefix_counts_are_those_of_the_library(sp, text):
    table = token_counts.counter(vocabulary("piece_bpe_32k.model")).table(text)
    assert table.tolist() == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["", " " * 40 + "word", "a" * 3000, "word " * 500, "x" * 70 + "\n" * 70, "unbelievable, thing.\nNext"])
def test_prefix_counts_of_long_texts(sp, text):
    table = token_counts.counter(vocabulary("piece_bpe_32k.model")).table(text)
    assert int(table[-1]) == len(sp.encode(text))
    fits = token_counts.fitting(table, 20)
    assert len(sp.encode(text[:fits])) <= 20 and all(len(sp.encode(text[:i])) > 20 for i in range(fits + 1, min(len(text), fits + 40) + 1))


def test_prefix_counts_do_not_wrap_over_cuts(sp):
    text = "1" * 40_000 + "\n" + "2" * 40_000
    table = token_counts.PrefixCounter(vocabulary("piece_bpe_32k.model")).table(text)
    assert int(table[-1]) == len(sp.encode(text)) > 80_000
    assert [int(table[i]) for i in (40_000, 40_001, 65_600)] == [len(sp.encode(text[:i])) for i in (40_000, 40_001, 65_600)]
    assert token_counts.fitting(table, 70_000) > 65_000 and (np.diff(table) >= 0).all()


def test_batches_of_a_budget():
    assert list(token_counts.batches_of([5, 5, 3, 20, 1, 1], 10)) == [[0, 1], [2], [3], [4, 5]]


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_no_dropout_is_the_plain_encoding_and_any_rate_decodes(sp, text):
    path = vocabulary("piece_bpe_32k.model")
    plain = dropout.encoder(path, 0.0, 1)
    if "▁" not in text:  # the library reads a literal mark as a space
        assert np.frombuffer(plain.encode([text])[0], "<i4").tolist() == sp.encode(text)
    for rate in (0.0, 0.1, 0.6, 1.0):
        own = dropout.encoder(path, rate, 3)
        assert own.decode(own.encode([text])[0]) == text


def test_dropout_is_seeded_and_varied():
    path = vocabulary("piece_bpe_32k.model")
    text = "unbelievable international considerations " * 20
    one, again, two = (dropout.DropoutEncoder(path, 0.3, seed).encode([text])[0] for seed in (1, 1, 2))
    assert one == again and one != two
    assert len(one) > len(dropout.encoder(path, 0.0, 1).encode([text])[0])
    assert len(dropout.encoder(path, 1.0, 1).encode(["abc de"])[0]) == 4 * 7


def test_matrix_and_heap_agree():
    own = dropout.DropoutEncoder(vocabulary("piece_bpe_32k.model"), 0.3, 5)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghinorst▁") for _ in range(rnd.randint(1, 20))) for _ in range(800)]
    variants = np.array([rnd.randrange(own.variants) for _ in words])
    assert own._many(words, variants) == [own._one(w, int(v)) for w, v in zip(words, variants, strict=True)]


def test_every_occurrence_of_a_word_draws_for_itself():
    own = dropout.DropoutEncoder(vocabulary("piece_bpe_32k.model"), 0.1, 1)
    n = 6000
    mark, whole = own.pieces.id["▁"], own.pieces.id["▁a"]
    ids = np.frombuffer(own.encode([" ".join(["a"] * n)])[0], "<i4")
    kept = ids[(ids == mark) | (ids == whole)] == whole  # one entry for each occurrence; its only merge is taken or skipped
    assert len(kept) == n and abs(kept.mean() - 0.9) < 0.02
    # neighbours do not share their draws
    assert abs((kept[1:] & kept[:-1]).mean() - 0.81) < 0.03
    # a frequent word has many forms within one text
    word = "internationalization"
    ids = np.frombuffer(own.encode([" ".join([word] * 2000)])[0], "<i4").tolist()
    forms = "".join(f"{'|' if own.pieces.text[i].startswith('▁') else '+'}{own.pieces.text[i]}" for i in ids).split("|")[1:]
    assert len(forms) == 2000 and len(set(forms)) > 40


def test_a_vocabulary_that_codes_cannot_hold_is_refused():
    from types import SimpleNamespace

    own = object.__new__(dropout.DropoutEncoder)
    own.pieces = SimpleNamespace(id={str(k): k for k in range((1 << 16) + 1)}, rank={})
    with pytest.raises(ValueError, match="65,536"):
        own._tables()


def test_remembered_branches_change_no_segmentation():
    path = vocabulary("piece_bpe_32k.model")
    rnd = random.Random(3)
    words = ["the", "international", "wörd", "▁", "considerations,", "x" * 30, "a.b\nc", "x" * 30 + ".", "😀😀", "unbelievable"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    fresh = [dropout.DropoutEncoder(path, 0.3, 9).encode([t])[0] for t in texts[:5]]
    together, small = dropout.DropoutEncoder(path, 0.3, 9), dropout.DropoutEncoder(path, 0.3, 9, cache_size=2, node_size=10)
    found = together.encode(texts)
    assert found == together.encode(texts) == [small.encode([t])[0] for t in texts] and found[:5] == fresh
    assert [together.decode(x) for x in found] == texts


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from([*PARTS, "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "\x85", "\xa0", "\x1c", "word"]), max_size=12).map("".join))
def test_chunk_tokenizer_gives_the_ids_of_the_library(text):
    own = packing.chunk_tokenizer(vocabulary("word_bpe_49k.json"))
    expected = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == expected


def test_a_full_cache_changes_nothing():
    small = packing.ChunkTokenizer(vocabulary("word_bpe_49k.json"), cache_size=3)
    big = packing.chunk_tokenizer(vocabulary("word_bpe_49k.json"))
    texts = [b"The quick, brown fox. Jumps!", b"over the lazy dog", b"", b"the quick fox"]
    assert small.encode(texts) == small.encode(texts) == big.encode(texts)


def brute_fingerprint(text: str) -> int:
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(["A", "b ", "É", "\n", "c d e ", "word ", "\x1f", "\x0b"]), max_size=20).map("".join))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_roots(values) -> dict[int, int]:
    n = len(values)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if int(values[i] ^ values[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    signed = np.array(values, np.uint64).view(np.int64)
    return {int(signed[i]): min(int(signed[j]) for j in range(n) if root[j] == root[i]) for i in range(n)}


@pytest.mark.parametrize("seed", range(6))
def test_runs_link_what_brute_force_links(seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(8)]
    values = set(centres)
    for c in centres:
        for _ in range(12):
            v = c
            for _ in range(rnd.randint(0, 6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    own = np.array(sorted(values), np.uint64)
    expected, signed = brute_roots(own), own.view(np.int64).tolist()
    differ = own[:, None] ^ own[None]
    due = (np.bitwise_count(differ) <= 3) & (np.bitwise_count(differ >> np.uint64(32)) <= 1)  # the other order finds the rest
    for cut, inside in ((0, True), (1, True), (50, True), (len(own), True), (50, False)):
        u, v, joint = simhash.linked(own[:cut], own[cut:], inside, leaf=4)
        found = dict(zip(u.tolist(), v.tolist(), strict=True))
        assert not joint and all(expected[a] == expected[b] for a, b in found.items())
        for i, j in zip(*np.nonzero(due), strict=True):
            if inside or (i < cut) != (j < cut):
                assert found.get(signed[i], signed[i]) == found.get(signed[j], signed[j])
    ball = np.unique(own[0] ^ np.array([0, *(1 << k for k in range(20))], np.uint64))
    assert simhash.linked(ball[:9], ball[9:], True, leaf=4)[2]


def test_levels_at_most_double():
    assert substrings.levels() == [9, 18, 35]
    assert all(b <= 2 * a for a, b in zip(substrings.levels(100, 7), substrings.levels(100, 7)[1:], strict=False))
    assert substrings.levels(3, 8) == [3]


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.integers(0, 3), min_size=1, max_size=60), length=st.integers(1, 12), window=st.integers(1, 14))
def test_window_hashes_and_representatives(words, length, window):
    own = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = substrings.doubled(own, length)
    assert len(found) == max(0, len(words) - length + 1)
    seen = {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(tuple(words[i : i + length]), h) == h
    assert len(set(seen.values())) == len(seen)
    if length <= window <= len(words):
        chosen = substrings.representatives(found, len(words) - window + 1)
        for p, at in enumerate(chosen.tolist()):
            span = found[p : p + window - length + 1]
            assert at == p + int(np.argmin(span))


@settings(max_examples=200, deadline=None)
@given(flags=st.lists(st.booleans(), max_size=50))
def test_runs_round_trip(flags):
    own = np.array(flags, bool)
    assert substrings._flags(substrings._runs(own), len(own)).tolist() == flags


def test_law_tables():
    assert audio.expansion(audio.MULAW)[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert audio.expansion(audio.ALAW)[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    for law in (audio.MULAW, audio.ALAW):
        table = audio.expansion(law)
        assert (audio.expand(audio.compress(table.astype(np.int32), law), law) == table).all()


def brute_adpcm(block: bytes) -> list[int]:
    predicted, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [predicted]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = audio.STEP_SIZES[index]
            gap = step >> 3
            gap += step if nibble & 4 else 0
            gap += step >> 1 if nibble & 2 else 0
            gap += step >> 2 if nibble & 1 else 0
            predicted = max(-32768, min(32767, predicted - gap if nibble & 8 else predicted + gap))
            index = max(0, min(88, index + audio.INDEX_STEPS[nibble & 7]))
            out.append(predicted)
    return out


@settings(max_examples=50, deadline=None)
@given(data=st.binary(min_size=64, max_size=64))
def test_adpcm_blocks(data):
    found = audio.decode_adpcm(np.frombuffer(data, np.uint8), 32)
    assert found.tolist() == [brute_adpcm(data[:32]), brute_adpcm(data[32:])]


def test_adpcm_follows_a_tone():
    tone = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    coded = audio.encode_adpcm(tone, 128)
    heard = audio.decode_adpcm(coded, 128).ravel()[: len(tone)]
    assert np.abs(heard.astype(int) - tone).mean() < 300


def test_wav_round_trips():
    tone = (8000 * np.sin(np.arange(1001) / 9)).astype(np.int16)
    codes = audio.compress(tone.astype(np.int32), audio.MULAW)
    for media, rate in ((audio.wav(codes.tobytes(), audio.MULAW, 8000, 8, 1), 8000), (audio.wav(tone.astype("<i2").tobytes(), audio.PCM, 16000, 16, 2), 16000)):
        samples, own = audio.samples_of(media)
        assert own == rate and len(samples) == len(tone) and np.abs(samples.astype(int) - tone).max() < 400
    assert audio.unwav(audio.wav(b"abc", audio.MULAW, 8000, 8, 1))[3] == b"abc"
    with pytest.raises(ValueError):
        audio.unwav(b"RIFFxxxxWAVE")
    with pytest.raises(ValueError):
        audio.unwav(audio.wav(b"abcdef", audio.MULAW, 8000, 8, 1)[:-4])
    assert len(audio.resample(tone, 8000, 16000)) == 2002 and len(audio.resample(tone, 16000, 8000)) == 500
    assert audio.resample(tone, 8000, 16000)[::2].tolist() == tone.tolist()


def test_padding():
    assert audio.padded(b"") == b" " * 192 and len(audio.padded(b"x" * 193)) == 384 and zlib.crc32(audio.padded(b"x" * 192)) == zlib.crc32(b"x" * 192)


def test_chunked_framing():
    assert warc.unchunk(b"3\r\nabc\r\na;x=1\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    for broken in (b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(broken)


def test_records_are_cut_by_their_lengths():
    block = b"WARC/1.1\r\n\r\nnot a record\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    assert [(h["warc-type"], b) for h, b in warc.parse(record * 2)] == [("x", block)] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record.replace(b"%d" % len(block), b"5")))
