import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm import helpers as h
from tests.llm.test_near_and_pii import plain_classes
from vulnlake.llm import mixing, packing, quality, toxicity


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > epochs * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(spark, docs, rows, **settings):
    m = mixing.mix(docs, **settings)
    taken = m["taken"].collect()
    assert Counter((r["doc_id"], r["size"]) for r in taken) == Counter((r[0], len(h.words(r[1]))) for r in rows)
    sizes, got = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(h.words(r[1]))
    want = plain_targets(sizes)
    for r in taken:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 0.5 for s in want)
    return m


def test_mix(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    m = check_mix(spark, docs, rows, slots=2000)
    # Pieces are what the blocks hold, and any prefix of the schedule is close to the targets.
    pieces = m["pieces"].collect()
    goal = {r["place"]: (r["target"], r["block"]) for r in m["sources"].collect()}
    total, block = sum(t for t, _ in goal.values()), goal[0][1]
    order = sorted({(r["slot"], r["place"]) for r in pieces})
    seen = Counter()
    for k, (_, place) in enumerate(order[: len(order) * 9 // 10], 1):
        seen[place] += 1
        if k % 100 == 0:
            assert all(abs(seen[p] - k * goal[p][0] / total) < 8 for p in goal), "low discrepancy"
    per_block = Counter()
    for r in pieces:
        per_block[r["place"], r["k"]] += r["words"]
    assert max(per_block.values()) == block and len({(r["place"], r["k"]): 0 for r in pieces}) == len(order)


def test_mix_edge_cases(spark):
    m = check_mix(spark, h.rows(spark), h.ROWS, slots=500)
    again = mixing.mix(h.rows(spark), slots=500)["taken"]
    assert sorted(map(str, m["taken"].collect())) == sorted(map(str, again.collect()))
    mixed = mixing.mixed(h.rows(spark), slots=500)
    assert mixed.columns == h.rows(spark).columns
    epochs = Counter()
    for r in m["taken"].collect():
        epochs[r["doc_id"]] += r["epochs"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in epochs.items() if v})
    for df in (h.empty(spark), h.rows(spark).where("doc_id IN (2, 3, 4)")):
        assert [r["taken"] for r in mixing.mix(df)["taken"].collect()] == [0] * df.count()
        assert mixing.mixed(df).count() == 0


def test_mixed_takes_the_words_of_the_targets(spark):
    """One long document per source: the target ends inside it, and so does what is emitted."""
    docs = [(k, "\n".join(f"w{k}  v{j}" for j in range(n)), s, -1) for k, (s, n) in enumerate([("a", 500), ("b", 400), ("c", 10), ("c", 300), (None, 200)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int")
    rows, want = mixing.mixed(df, slots=500).collect(), {r["source"]: r["want"] for r in mixing.mix(df, slots=500)["sources"].collect()}
    got, texts = Counter(), {d[0]: d[1] for d in docs}
    for r in rows:
        got[r["source"]] += len(h.words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] in (-1, len(r["text"])) and (r["n_chars"] == -1) == (r["text"] == texts[r["doc_id"]])
    assert got == want and any(r["n_chars"] != -1 for r in rows)


def check_packing(rows, docs):
    """Every word of every document once, no bin over its capacity, offsets side by side, the least capacity that holds it."""
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["n_words"]))
        if r["n_words"]:
            bins[r["bin_id"]].append((r["bin_offset"], r["n_words"], r["capacity"]))
        else:
            assert r["bin_id"] is None
    want = defaultdict(list)
    for i, t in docs:
        n = len(h.words(t))
        want[i] += [(s, min(4096, n - s)) for s in range(0, n, 4096)] or [(0, 0)]
    assert {i: sorted(x) for i, x in by.items()} == {i: sorted(x) for i, x in want.items()}
    for b in bins.values():
        at = 0
        for offset, n, _ in sorted(b):
            assert offset == at
            at += n
        assert {c for *_, c in b} == {min(x for x in packing.LENGTHS if x >= at)}
    return sum(b[0][2] for b in bins.values()), sum(n for b in bins.values() for _, n, _ in b)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    room, used = check_packing(packing.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used / room > 0.98
    check_packing(packing.pack(h.rows(spark), group_items=3).collect(), [r[:2] for r in h.ROWS])
    assert packing.pack(h.empty(spark)).count() == 0


def test_best_fit_against_a_plain_version():
    import random

    rng = random.Random(4)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 30))), reverse=True)
        place, capacity = packing.best_fit(sizes, [60, 100])
        room = []
        for k, (size, b) in enumerate(zip(sizes, place)):
            fits = [(free, i) for i, free in enumerate(room) if free >= size]
            if fits:
                assert (room[b], b) == min(fits)
            else:
                assert b == len(room)
                room.append(capacity[b])
            room[b] -= size
        place, offset, final = packing.pack_group(sizes, (30, 60, 100))
        assert all(sum(s for s, p in zip(sizes, place) if p == b) <= c for b, c in enumerate(final)) and len(offset) == len(sizes)


@pytest.fixture(scope="module")
def toxic(spark):
    """Mock documents: toxic ones hold a word that is in no other, each word in about an eighth of them."""
    import random

    rng = random.Random(6)
    neutral, bad = [f"n{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)], ["glorp", "snark", "blurgh", "vexing", "zonked", "krump"]
    docs, labels = [], []
    for i in range(1500):
        w, y = [rng.choice(neutral) for _ in range(60)], int(rng.random() < 0.15)
        for _ in range(3 * y):
            w[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    labels += [(10**6, 1), (None, 1), (3, None), (5, labels[5][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:1500])


def test_toxicity_held_out(spark, toxic):
    docs, labels, truth = toxic
    train = toxicity.training_rows(docs, labels)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in train.collect())
    model = toxicity.fit(train)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 1500 and all((r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)) and (r["predicted"] == (r["score"] >= 0.5)) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    report = model[2]
    odds = dict(zip(report["voters"], report["odds"]))
    assert max(odds[f"words{k}"][2] for k in range(8)) > 2 and abs(report["correlation"][0]).max() > 0
    assert toxicity.score(docs, toxicity.fit(train)).exceptAll(toxicity.score(docs, model)).count() == 0


def test_label_model_recovers_votes_and_discounts_copies():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    voters = [np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.9, 0.8, 0.7)]
    votes = np.stack([*voters, voters[2], voters[2]], axis=1).astype(float)  # two copies of the weakest
    given = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    post, _, correlation = toxicity.label_model(votes, given)
    weight, _ = toxicity.discount(votes, post)
    assert ((post > 0.5) == y).mean() > 0.93 and weight[2] < 0.5 < weight[0] and correlation[2, 3] > 0.9


def test_toxicity_edge_cases(spark, toxic):
    assert toxicity.fit(toxicity.training_rows(h.rows(spark), toxic[1].where("toxic = 0"))) is None
    got = toxicity.score(h.rows(spark), None).collect()
    assert len(got) == len(h.ROWS) and {r["score"] for r in got} == {0.0}
    model = toxicity.fit(toxicity.training_rows(*toxic[:2]))
    scored = {r["doc_id"]: r for r in toxicity.score(h.rows(spark), model).collect()}
    assert scored[2]["score"] == scored[3]["score"] < 0.5 and scored[None]["held_out"]
    assert toxicity.score(h.empty(spark), model).count() == 0


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF_DIR)
    good = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == docs.columns
    single = stages["near_dedup"](spark, kept, SF_DIR)
    classes = plain_classes(sorted((i, rows[i]["text"] or "") for i in good))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values())) and single.columns == docs.columns
    clean = stages["pii_surrogates"](spark, single, SF_DIR)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    private = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|AKIA[A-Z0-9]{16}|(?<=password=)\w+")
    for i, text in texts.items():
        old = rows[i]["text"]
        assert all(m not in text for m in private.findall(old)) and (text == old or private.search(old) or re.search(r"\d", old))
    mix = stages["source_mixing"](spark, clean, SF_DIR)
    assert mix.columns == docs.columns and set(Counter(r["doc_id"] for r in mix.collect()).values()) <= {1, 2}
    check_packing(stages["best_fit_packing"](spark, mix, SF_DIR).collect(), [(r["doc_id"], r["text"]) for r in mix.collect()])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii_surrogates", "source_mixing", "best_fit_packing"]


def test_pipeline_query_and_empty_tables(spark):
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.count() > 0 and whole.columns == ["doc_id", "piece", "start", "n_words", "bin_id", "capacity", "bin_offset"]
    docs = h.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
    docs = h.rows(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() > 0
