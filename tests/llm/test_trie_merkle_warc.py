"""Prefix trie, Merkle manifest and capture index against plain versions and round trips."""

import base64
import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm.helpers import empty, rows
from vulnlake.llm import merkle, prefix_trie, warc
from vulnlake.llm.common import shared_folder

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(data, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild and c is not None else 0
        seqs[c] = own.get(c - c % 100, [])[:h] + turns[h:] if h else turns
    members, ends = defaultdict(list), defaultdict(list)
    order = lambda c: (c is not None, c or 0)
    for c in sorted(seqs, key=order):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
        ends[tuple(seqs[c])].append("null" if c is None else str(c))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in kids[p]) if kids[p] else 1
        saved = sum(totals[k][1] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        totals[p] = leaves, saved
    return sorted([(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *totals[p], hashlib.sha256(",".join(ends[p]).encode()).hexdigest()) for p, m in members.items()], key=str)


def awkward_turns():
    data = [(c, t, "user" if t % 2 == 0 else "bot", f"text {(c % 3) if t < 3 else c % (t + 1)}") for c in range(0, 240, 3) for t in range(c % 11)]
    data += [(100, t, "user", f"text {t % 3}") for t in range(12)]
    data += [(500, t, "user", "deep" if t % 5 else f"deep {t % 7}") for t in range(75)] + [(501, t, "user", "deep" if t % 5 else f"deep {t % 7}") for t in range(70)]
    data += [(502, t, "user", "deep" if t % 5 else f"deep {t % 7}") for t in range(64)]
    data += [(7, None, None, None), (7, None, "a", "x"), (7, 1, "", "same"), (7, 1, "", "same"), (None, 1, "user", "text 0"), (None, 0, "user", ""), (-150, 1, "u", "Straße 日本"), (-200, 1, "u", "x́")]
    data += [(c, 0, "user", "one first turn for all of them") for c in range(1000, 1080)] + [(900, 3, "u", "w " * 30_000)]
    return data


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_trie_equals_plain_version(spark, leaf):
    data = awkward_turns()
    df = spark.createDataFrame(data, TURNS).selectExpr("*", "1 AS d", "'y' AS name", "2 AS x", "3 AS conv", "4 AS _part")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df.repartition(5))), leaf)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(data)


def test_trie_of_conversations_as_they_are_and_of_none(spark):
    data = awkward_turns()
    got = prefix_trie.trie(prefix_trie.as_they_are(prefix_trie.turns_of(spark.createDataFrame(data, TURNS))))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(data, rebuild=False)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame([], TURNS)))).count() == 0


def test_ends_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    df = spark.range(0, 500).selectExpr("unhex(hex(CAST(id % 2 AS string))) AS name", "id AS conv")
    got = {bytes(r["name"]): r["ends_sha256"] for r in prefix_trie.ends_hashed(df).collect()}
    assert got == {str(k).encode(): hashlib.sha256(",".join(str(i) for i in range(k, 500, 2)).encode()).hexdigest() for k in (0, 1)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(data, arity, changed=lambda r: r[4]):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha(*map(field, (r[0], r[3], r[2], n, r[1])))

    def tree(hashes):
        """Root and, per leaf, the list of (before, after)."""
        paths, place, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(level) > 1:
            for i, at in enumerate(place):
                run = at - at % arity
                paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
                place[i] = at // arity
            level = [sha(*level[k : k + arity]) for k in range(0, len(level), arity)]
        return level[0], paths

    groups = defaultdict(list)
    for r in data:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, changed(r)), r[0]))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    done = {k: tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    root, above = tree([done[k][0] for k in keys])
    out = []
    for k, up in zip(keys, above):
        for x, path in zip(sorted(groups[k], key=lambda x: x[:3]), done[k][1]):
            folded = x[3]
            for before, after in path + up:
                folded = sha(before, folded, after)
            out.append((x[4], x[2], done[k][0], root, sha(*[b + a for b, a in path + up]), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_plain_version(spark, arity):
    from pyspark.sql import functions as F

    df = rows(spark).selectExpr("*", "1 AS hash", "2 AS idx", "3 AS n", "'q' AS path")
    more = [(i, f"text {i}", ["en", "de", "", "é", "zz"][i * i % 5], "s", i) for i in range(20, 120)]
    from tests.llm.helpers import ROWS, SCHEMA

    df = df.select("doc_id", "text", "lang", "source", "n_chars", "hash", "idx", "path").unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    tampered = F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verified(merkle.manifest(df, arity=arity, changed=tampered)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    change = lambda r: r[4] + 1 if r[0] is not None and r[0] % 4 == 0 and r[4] is not None else r[4]
    want = plain_manifest(ROWS + more, arity, change)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    assert merkle.verified(merkle.manifest(empty(spark))).count() == 0
    one = merkle.verified(merkle.manifest(rows(spark).where("doc_id = 7"))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == sha("")


PAGES = "page_id long, url string, html string"
SAME = [(30, "http://b.example.com/x", "<p>same</p>"), (10, "http://a.example.com/y", "<p>same</p>"), (20, "http://a.example.com/y", "<p>same</p>"), (20, "http://a.example.com/y", "<p>same</p>"), (None, "http://c.example.com/", "<p>same</p>")]


def pages():
    data = SAME + [(1, None, None), (2, "", ""), (3, "not a url\r\nX: y", "é 日本 \r\n\r\n"), (4, "https://u:p@WWW.Example.com:8080/p?q#f", "w " * 200_000), (5, "http://[::1]:80", None), (5, "http://[::1]:80", "other")]
    return data + [(100 + i, f"http://h{i % 9}.example.org/{i % 40}", f"page {i % 25}") for i in range(300)] + [(1000 + i, "http://hot.example.net/", f"hot {i}") for i in range(300)]


def plain_records(data, least=0):
    seen, out = {}, []
    for page_id, _, html in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = len(body) >= least and body in seen
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", seen[body] if again else None))
        seen.setdefault(body, page_id)
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_archive_round_trip_through_the_index(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "FILE_BYTES", 5_000)
    data, folder = pages(), shared_folder(spark, "warc-test")
    df = spark.createDataFrame(data, PAGES).selectExpr("*", "1 AS size", "2 AS key", "3 AS sha", "4 AS who").repartition(3)
    index = warc.archive(df, folder, least=least)
    found = warc.captures(warc.keys_of(df), index)
    got = warc.records(found, folder)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str) == plain_records(data, least)
    texts = {r["payload_digest"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert set(texts.values()) == {h or "" for _, _, h in data}
    # Some keys, one of which fills many blocks, and one that is not there.
    want = {warc.capture_key(u) for u in ("http://hot.example.net/", "http://h3.example.org/3", "http://nowhere.example/")}
    some = warc.captures(spark.createDataFrame([(k,) for k in want], "key string"), index)
    assert sorted(r["page_id"] for r in some.collect()) == sorted(p for p, u, _ in data if warc.capture_key(u) in want)


def test_archive_of_no_pages(spark):
    folder = shared_folder(spark, "warc-none")
    none = spark.createDataFrame([], PAGES)
    index = warc.archive(none, folder)
    assert warc.records(warc.captures(warc.keys_of(none), index), folder).count() == 0


def test_capture_keys():
    for url, key in {"http://www.Example.com/a?b#c": "com,example,www)/a?b", "https://example.com:443": "com,example)/", "http://1.2.3.4:81/x": "1.2.3.4:81)/x", "//a.b/c": ",b,a)/c"}.items():
        assert warc.capture_key(url) == (key if url[0] != "/" else warc.capture_key(url))
    assert warc.capture_key(None) == warc.capture_key("") == "" and "\n" not in warc.capture_key("http://a/\nb")
