import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from tests.conftest import SF_DIR
from tests.llm import helpers as h
from vulnlake.llm import fingerprints as fp, wavelet
from vulnlake.llm.common import shared_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def by_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_ids_from_files(spark, size):
    folder = shared_folder(spark, "wavelet")
    wavelet.write_ids(h.rows(spark), FILE, folder, shard_tokens=size)
    rows = in_order(h.ROWS)
    ids = by_library([r[1] for r in rows])
    starts = np.cumsum([0, *map(len, ids)])
    want = sorted((str(r[0]), int(s), len(x), zlib.crc32(x)) for r, s, x in zip(rows, starts, ids))
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_back(spark, folder).collect()) == want
    value = int(ids[1][0])
    places = sorted((str(r[0]), int(i)) for r, x in zip(rows, ids) for i in np.flatnonzero(x == value))
    assert sorted((str(r["doc_id"]), r["position"]) for r in wavelet.occurrences(spark, folder, value).collect()) == places


def test_no_documents_no_files(spark):
    folder = shared_folder(spark, "wavelet")
    assert wavelet.write_ids(h.empty(spark), FILE, folder).count() == 0
    assert wavelet.read_back(spark, folder).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 70_000])
def test_matrix_operations(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3001).astype(np.uint32)
    m, doc_ids, ends = wavelet.from_bytes(wavelet.to_bytes(ids, [7, None], [3000, 3001]))
    assert (m.decode() == ids).all() and doc_ids == [7, None] and ends == [3000, 3001]
    assert [m.access(i) for i in range(0, 3001, 97)] == ids[::97].tolist()
    for value in {int(ids[0]), int(ids[-1]), top + 5}:
        at = np.flatnonzero(ids == value)
        assert m.count(value) == len(at) and m.count(value, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        assert [m.occurrence(value, k) for k in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            m.occurrence(value, len(at))


def test_chunked_encoding_equals_the_library():
    encoder, rng = wavelet.Encoder(FILE), random.Random(3)
    parts = [" ", "  ", "a", "é", "\n", "\t", "'s", " ", "12", ".", ", ", ". ", ".\n", "Ġ", "日", "　", "\r", "<|endoftext|>", "\x00", "\x01", " x", "\nz", "word", "%", "_", "²"]
    texts = ["", " ", "a ", "\n", "a\n\nb"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    got = [x for at in range(0, len(texts), 500) for x in encoder.encode(texts[at : at + 500])]
    assert all(a.tolist() == b[:-1].tolist() for a, b in zip(got, by_library(texts)))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(parts):
    x = 42
    for p in parts:
        x = xxhash.xxh64(p, seed=x).intdigest()
    return signed(x)


def plain_fingerprint(text):
    w = h.words(text)
    hashes = {chained([" ".join(w).encode()])} if 0 < len(w) < 5 else {chained([x.encode() for x in w[i : i + 5]]) for i in range(len(w) - 4)}
    if not hashes:
        return "-"
    least, number = {}, lambda i: int(i).to_bytes(4, "little")
    for x in hashes:
        b = (x >> 56) + 128
        least[b] = min(least.get(b, x), x)
    out = ""
    for i in range(fp.BINS):
        tried = (least.get(chained([number(i), number(t)]) % fp.BINS) for t in range(fp.PROBES))
        value = least.get(i) if i in least else next((x for x in tried if x is not None), None)
        if value is None:
            value = min((chained([number(i), number(b)]), x) for b, x in least.items())[1]
        out += fp.DIGITS[chained([(value & (1 << 64) - 1).to_bytes(8, "little"), number(i)]) & 15]
    return out


def test_fingerprints_against_brute_force(spark):
    rows = sorted({r[:2] for r in h.ROWS}, key=str)
    got = {str(r["doc_id"]): r["fingerprint"] for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {str(i): plain_fingerprint(t) for i, t in rows}
    assert fp.fingerprints(h.empty(spark)).count() == 0


def test_edited_texts_and_likeness(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id", ascending=False).collect()]
    got = {r["doc_id"]: r for r in fp.edited_likeness(docs).collect()}
    errors = []
    for k, (i, t) in enumerate(rows):
        after, half, r = rows[(k + 1) % len(rows)][1], len(t) // 2, got[i]
        edited = t[: len(t) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if k % 20 == 0:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(t), plain_fingerprint(edited))
        errors += [abs(r["near_edited"] - h.jaccard(h.shingles(t), h.shingles(edited))), abs(r["near_next"] - h.jaccard(h.shingles(t), h.shingles(after)))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_edited_edge_cases(spark):
    got = fp.edited_likeness(h.rows(spark)).collect()
    assert len(got) == len(h.ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_chars"] == 0 and by[3]["near_next"] == 1.0  # after document 3 comes 2, both without words
    alone = fp.edited_likeness(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 7)]
    assert fp.edited_likeness(h.empty(spark)).count() == 0
