import tracemalloc
import zlib

import numpy as np
import pytest

from quire.llm import bpe, queries, wavelet


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 50, 50257])
def test_shard_round_trip_and_queries(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u2")
    shard = wavelet.Shard(wavelet.write_shard([3, None], [ids[: n // 2].tobytes(), ids[n // 2 :].tobytes()], ids.dtype))
    assert shard.tokens().tolist() == ids.tolist() and len(shard) == n
    assert shard.doc_ids == [3, None] and shard.doc_starts.tolist() == [0, n // 2, n]
    assert [shard.token(i) for i in range(0, n, 61)] == ids[::61].tolist()
    for t in {*ids[:9].tolist(), 7}:
        assert shard.occurrences(t) == np.flatnonzero(ids == t).tolist()
        assert shard.count(t, n // 4, n // 2) == int((ids[n // 4 : n // 2] == t).sum())
    with pytest.raises(IndexError):
        shard.token(n)


def test_queries_open_few_parts():
    """A token is read from one part of each plane, and of each plane's ranks, and the alphabet's."""
    ids = np.random.default_rng(0).integers(0, 40_000, 1 << 20).astype("<u2")
    shard = wavelet.Shard(wavelet.write_shard([1], [ids.tobytes()], ids.dtype))
    opened = lambda: sum(len(s.parts) for s in shard.sections)
    whole = sum(len(s.bounds) - 1 for s in shard.sections)
    assert opened() == 0 and shard.token(300_000) == ids[300_000]
    assert 0 < opened() <= 2 * 16 + 1 < whole / 3
    assert shard.count(int(ids[5]), 100, 9000) == int((ids[100:9000] == ids[5]).sum())
    assert opened() < whole
    assert shard.occurrences(int(ids[5])) == np.flatnonzero(ids == ids[5]).tolist() and shard.tokens().tolist() == ids.tolist()


def test_building_keeps_no_places_of_all_numbers():
    """Numbers are parted run by run; places of all of them at once were four times their size."""
    numbers = np.random.default_rng(1).integers(0, 40_000, 1 << 20).astype(np.uint16)
    tracemalloc.start()
    matrix = wavelet.WaveletMatrix.build(numbers, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert matrix.decode().tolist() == numbers.tolist() and peak < 6 * numbers.nbytes


def test_encoder_equals_the_library(texts):
    enc = bpe.Encoder()
    odd = ["a  b", " a", "a ", "\n b", "a\n b  c\x1c d", "x <|endoftext|> y", "don't  \t you'll 've", "", " ", "日本 語 ２３ ²", "é a\x85 b 　 c", "ª º ¼ a²b", "\x00 a", "  \n  x"]
    for t in [*odd, *texts.values()]:
        assert enc.encode(t).tolist() == enc.library.encode(t, add_special_tokens=False).ids, t[:50]


def test_cuts_fall_between_the_library_s_pretokens():
    enc, pick = bpe.Encoder(), np.random.default_rng(3)
    parts = ["a", "é", "É", "ß", "1", "²", "ª", "日", "_", ".", ",", "'", "'s", "'ll", "&", "»", "×", " ", " ", "\n", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\0", "the", "\U0001f600"]
    for size in pick.integers(1, 14, 6000):
        text = "".join(pick.choice(parts, size))
        assert enc.encode(text).tolist() == enc.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_word_is_encoded_once_whatever_follows_it(monkeypatch):
    enc, asked = bpe.Encoder(), []
    ids = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda letters: asked.append(letters) or ids(letters))
    text = "x oftionnten oftionnten, oftionnten. oftionnten.\nAnd oftionnten*** oftionnten's oftionnten\nThe oftionnten; oftionnten"
    assert enc.encode(text).tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert sum("oftionnten" in a for a in asked) == 1


def expected(rows):
    library, at, out = bpe.encoder().library, 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf_dir, texts):
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_wavelet_shards(spark, sf_dir).collect())
    assert found == expected(texts.items())


def test_defined_results(nasty, nothing, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    found = wavelet.read_documents(wavelet.write_shards(nasty, shard_tokens=50)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ours = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=key)
    assert ours == expected([(r["doc_id"], r["text"]) for r in nasty.collect()])
    assert wavelet.read_documents(wavelet.write_shards(nothing)).count() == 0
