import random

import duckdb
import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm import helpers as h
from vulnlake.llm import quality, token_counts, url_filter
from vulnlake.llm.registry import ORACLES, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert got.columns == columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_quality_edge_cases(spark):
    got = {r["doc_id"]: r for r in quality.judge(h.rows(spark), names=True).collect()}
    assert got[3]["n_words"] == 0 and not got[3]["kept"] and got[2]["base_failed"]
    assert got[9]["n_repeat_words"] == 300 and got[9]["base_failed"]
    assert got[7]["n_words"] == 48000 and "repeated_windows" in got[7]["failed_rules"]
    assert got[8]["n_dup_lines"] == 2 and got[8]["n_lines"] == 4
    assert got[None]["kept"] and got[1]["kept"]
    kept = quality.keep_good(h.rows(spark))
    assert kept.columns == h.rows(spark).columns
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == ["1", "1", "None"]
    assert quality.judge(h.empty(spark)).count() == 0 and quality.keep_good(h.empty(spark)).count() == 0


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(50)]

    def plain(text):
        w = h.words(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)})

    df = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_quality_is_native(spark, capsys):
    quality.judge(h.rows(spark)).explain()
    assert "Python" not in capsys.readouterr().out


def test_token_counts(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    got = token_counts.token_counts(h.rows(spark), file, limit=1000)
    want = sorted(str((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 1000)) for i, t, *_ in h.ROWS)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert token_counts.token_counts(h.empty(spark), file).count() == 0


def test_token_counts_of_odd_spacing():
    pieces = token_counts.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    parts = [" ", "  ", "a", "the", "é", "\n", "\t", "<s>", "\u00a0", "1", "▁", "日", " \u0301"]
    texts = ["", " ", "  ", "a ", " a", "a  b "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert pieces.count(texts).tolist() == [len(x) for x in pieces.model.encode(texts)]


URLS = ["http://A.Example.COM/en/1", "https://www.example.com/en/?q", "http://x.net/es/a", "http://net/fr/", "http://xnet/es/", "http://a.com", "http://a.com?x=/en/", "no scheme", None, "",
        "http://b.org/p.net/es/", "x://y://z.com/", "http://m.spam-farm.org/a", "http://ok.org/.spam-farm.x", "http://ümlaut.example.com/en/é", "http://a.com:80/", "http://" + "a" * 5000 + ".com/" + "b" * 5000]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS)] + [(0, URLS[0], "host")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert [got[i][2] for i in range(1, 11)] == ["www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, None]
    assert got[11][:3] == ("y:", "//z.com/", None) and got[8][:2] == ("", "")
    assert [got[i][3] for i in (12, 13)] == ["block", "allow"]
    assert got[14][2] == "example.com/en/" and got[15][2] is None and got[16][2] == "com/"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_shift_and_against_regular_expressions():
    import re

    rng = random.Random(7)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", ".", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 12))).encode() for _ in range(400)]
    plain = [re.compile("".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|\*|[^*]", g)).encode(), re.S) for g in globs]
    size = np.array([len(t) for t in texts])
    got = url_filter.ShiftAnd(globs).first(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [next((k for k, p in enumerate(plain) if p.fullmatch(t)), -1) for t in texts]
