"""Cases of the review of round 1: each would have failed before."""

import hashlib

import numpy as np
import pytest

from tallywright.llm import latent_decontam, parity_join, secrets
from tallywright.operators import status

rng = np.random.default_rng(8)


def names(n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(n)]


def test_parity_join_tests_bridges_of_chains(spark, monkeypatch):
    """y1-x-y2-y3 are near copies in a row; x and y2 are nearer to others and meet in one key only, with a set like neither."""
    x = names(100)
    y1, y2 = x + names(5), x[11:]
    texts = {1: y1, 2: x, 3: y2, 4: y2[4:], 5: names(100), 6: names(100)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in parity_join.sketches(docs, 4, 85).collect()}
    sets = {i: {tuple(t[k : k + 4]) for k in range(len(t) - 3)} for i, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links == {(1, 2), (2, 3), (3, 4)}
    band = 128
    keys = [(band, (1, 2, 5)), (2 * band, (3, 4, 6)), (3 * band, (2, 3, 5))]
    met = spark.createDataFrame([(k, fps[i]) for k, ids in keys for i in ids], "key long, fp long")
    monkeypatch.setattr(parity_join, "_buckets", lambda exploded, percent: met)
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


@pytest.fixture(scope="module")
def filled_benchmark():
    """1,200 items of 40 words of a skewed vocabulary, 3,600 passages; texts that hold them whole and in part."""
    words = np.array(names(6000))
    share = 1 / np.arange(20, 6020)
    pick = lambda n: words[rng.choice(6000, n, p=share / share.sum())]
    items = [pick(40) for _ in range(1200)]
    texts = []
    for k in range(0, 1200, 12):
        for replaced in (0, 8):
            t = items[k].copy()
            t[rng.choice(40, replaced, replace=False)] = "other"
            texts.append((2 * k + bool(replaced), " ".join([*pick(45), *t, *pick(60)])))
    return [(k, " ".join(t)) for k, t in enumerate(items)], texts


def test_decontamination_finds_items_of_a_large_benchmark(spark, filled_benchmark):
    items, texts = filled_benchmark
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_decontam.contaminated(docs, bench).collect()}
    assert {(i, i // 2) for i, _ in texts} <= got


def test_decontamination_finds_short_items_beside_rare_words(spark):
    common, rare = names(200), names(4000)
    item = [str(w) for w in rng.choice(common, 15, replace=False)]
    docs = [(k, " ".join([*rng.choice(common, 60), *rng.choice(rare, 3)])) for k in range(300)]
    docs.append((1000, " ".join([*rng.choice(rare, 16), *item, *rng.choice(rare, 40)])))
    got = {(r.doc_id, r.item_id) for r in latent_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert (1000, 1) in got


def test_secrets_at_every_place(spark):
    key, other = hashlib.sha1(b"a").hexdigest(), hashlib.sha1(b"b").hexdigest()
    texts = {
        1: f"see https://api.host1.example.com/v1/x?token={key} now",
        2: f'{{"id":"page-12-of-34-in-a-book","api_key":"{key}","client_secret":"{other}"}}',
        3: f'commit {key} was merged by the old team, later the new team wrote token = "{key}" there',
        4: "é " * 30 + " ".join(f"token={hashlib.sha1(bytes([k, 1, j])).hexdigest()}" for k in range(200) for j in range(3)),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = secrets.scan(df).collect()
    assert all(texts[r.doc_id][r.position - 1 :].startswith(r.value) for r in found)
    assert len([r for r in found if r.doc_id == 4]) == 600
    assert {(r.doc_id, r.value) for r in found if r.is_secret and r.doc_id < 4} == {(1, key), (2, key), (2, other), (3, key)}
    assert sorted((r.position, r.is_secret) for r in found if r.doc_id == 3) == [(8, False), (texts[3].rindex(key) + 1, True)]
    assert not any(key in r.text or other in r.text for r in secrets.redacted(df).collect())


def test_rough_plan(spark):
    before = spark.createDataFrame([(1, 5, True), (2, 5, True), (3, 5, False), (4, None, True), (6, 0, None)], "id long, total long, complete boolean")
    now = spark.createDataFrame([(1, 5), (2, 6), (3, 5), (4, 5), (5, 5), (6, 0)], "id long, total long")
    got = {r.id: r.action for r in status.rough_plan(before, now, ["id"]).collect()}
    assert got == {1: "skip_rough"} | dict.fromkeys(range(2, 7), "fetch")
