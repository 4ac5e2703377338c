import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from headway.llm import quality as Q


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A calm and pleasant text about the weather. " * 5), (5, "You worthless idiot, what a moron. " * 3), (6, "word*** other### third%%% fourth$$$ " * 12), (7, "BUY!! NOW!! THIS!! THING!! " * 20), (8, "x " * 9000), (4, "A calm and pleasant text")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, kept string")
    model = Q.train(df, spark.createDataFrame([(5, 1, 1), (4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int"))
    got = {(r.doc_id, r.text): r.kept for r in Q.score(df, model).collect()}
    assert len(got) == 9 and {d for (d, _), k in got.items() if not k} == {5, 6, 7, 8}
    nulls = spark.createDataFrame([(None, "You worthless idiot, what a moron."), (None, "A calm text"), (None, None)], "doc_id long, text string")
    assert sorted(r.kept for r in Q.score(nulls, model).collect()) == [False, True, True]
    assert [r.text for r in Q.filtered(nulls, model).collect()] == ["A calm text", None]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Q.score(none, Q.train(none, None)).count() == 0


def test_em_finds_rates():
    rng = np.random.default_rng(1)
    bad = rng.random(40_000) < 0.1
    votes = np.stack([np.where(bad, rng.random(len(bad)) < h, rng.random(len(bad)) < 0.001) for h in (0.9, 0.7, 0.5)], axis=1)
    codes, n = np.unique(votes @ [1, 2, 4], return_counts=True)
    post, hit, _ = Q.em(dict(zip(codes.tolist(), n.tolist())), 3)
    assert np.allclose(hit, [0.9, 0.7, 0.5], atol=0.04)
    assert post[7] > 0.99 and post[0] < 0.05


def test_em_like_a_plain_one():
    """Another EM, over single documents instead of pattern counts."""
    rng = np.random.default_rng(3)
    bad = rng.random(900) < 0.2
    votes = np.stack([rng.random(900) < np.where(bad, h, f) for h, f in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01))], axis=1).astype(int)
    post = np.where(votes.any(axis=1), 0.9, 0.001)
    for _ in range(100):
        prior = (post.sum() + 1) / (len(post) + 20)
        hit = np.clip([(post[votes[:, k] == 1].sum() + 1) / (post.sum() + 2) for k in range(3)], 1e-4, 1 - 1e-4)
        false = np.clip([((1 - post)[votes[:, k] == 1].sum() + 0.01) / ((1 - post).sum() + 2) for k in range(3)], 1e-4, 1 - 1e-4)
        a, b = prior * np.prod(np.where(votes, hit, 1 - hit), axis=1), (1 - prior) * np.prod(np.where(votes, false, 1 - false), axis=1)
        post = np.where(votes.any(axis=1), a / (a + b), np.minimum(a / (a + b), 0.01))
    codes, n = np.unique(votes @ [1, 2, 4], return_counts=True)
    got, h, f = Q.em(dict(zip(codes.tolist(), n.tolist())), 3)
    assert np.allclose(h, hit, atol=1e-4) and np.allclose(f, false, atol=1e-4)
    assert all(abs(got[c] - p) < 1e-4 for c, p in zip((votes @ [1, 2, 4]).tolist(), post))


def test_fit_like_plain_gradients(spark):
    """The regression against gradient descent on what it is to make small."""
    rng = np.random.default_rng(5)
    x = (rng.random((200, 6)) < 0.4).astype(float)
    pattern = (rng.random(200) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, -2] - 0.5)))).astype(int)
    p = np.where(pattern == 1, 0.9, 0.05)
    rows = spark.createDataFrame([(int(c), np.flatnonzero(r).tolist()) for c, r in zip(pattern, x)], "pattern int, features array<int>")
    bias, weights = Q.fitted(rows, {0: 0.05, 1: 0.9})
    w, b = np.zeros(6), 0.0
    for _ in range(6000):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - p
        w, b = w - 0.5 * (x.T @ gap / 200 + Q.PENALTY * w), b - 0.5 * gap.mean()
    assert np.allclose(x @ weights[:6] + bias, x @ w + b, atol=0.05) and not weights[6:].any()
    assert Q.fitted(rows.limit(0), {0: 0.1})[1].any() == 0


def test_words_of_the_same_structure_differ():
    """Words that sums of products over their bytes take for the same."""
    a = b"a"
    b = b"b"
    for _ in range(11):
        a, b = a + b, b + a
    x, y = Q.Batch([a]).words, Q.Batch([b]).words
    assert len(a) == 2048 and x[0] != y[0]
    assert Q.Batch([b"Word, word WORD! other"]).words.tolist()[:3] == [Q.Batch([b"word"]).words[0]] * 3


def test_held_out(spark):
    """The scorer alone, on rows whose labels took no part: not even insult words are read from them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = Q.score(docs, Q.train(docs, labels.where(half == 0))).join(labels.where(half == 1), "doc_id").toPandas()
    bad = (got.quality == 0) | (got.toxic == 1)
    assert len(got) > 150 and (~got.kept[bad]).mean() > 0.9 and got.kept[~bad].mean() > 0.98


def test_copies_count_once(spark):
    """A third of the rows being one text changes nothing that is learned."""
    rows = [(i, f"word{i % 7} more{i % 5} text{i}" + (" you worthless scum" if i % 9 == 0 else "")) for i in range(120)]
    one = Q.train(spark.createDataFrame(rows, "doc_id long, text string"), None)
    two = Q.train(spark.createDataFrame(rows + [(1000 + k, rows[3][1]) for k in range(60)], "doc_id long, text string"), None)
    assert np.allclose(one["toxic"]["weights"], two["toxic"]["weights"], atol=1e-6) and one["toxic"]["posterior"] == two["toxic"]["posterior"]


def some_rows(spark, n: int = 90):
    rng = np.random.default_rng(7)
    x = rng.random((n, 5)) < 0.5
    x = np.concatenate([x, np.zeros((n, 1), bool)], axis=1)
    pattern = rng.integers(0, 3, n)
    return x, pattern, spark.createDataFrame([(int(p), np.flatnonzero(r).tolist()) for p, r in zip(pattern, x)], "pattern int, features array<int>").repartition(3)


def test_gradients_reach_the_driver_in_blocks(spark):
    """Sums of all partitions against plain ones; no piece holds a vector of all features, as results of whole gradients did."""
    x, pattern, rows = some_rows(spark)
    w, shares = np.zeros((2, Q.DIMENSIONS)), [{0: (0.9, 0.1), 1: (0.0, 1.0)}, {0: (0.3, 0.7), 1: (0.5, 0.5), 2: (0.2, 0.8)}]
    w[:, :5] = [[1, -1, 0.5, 2, 0], [0, 0.3, -2, 1, 1]]
    got = Q.gradients(rows, shares, [(0.25, w[0]), (-1.0, w[1])])
    for total, bias, weights, own in zip(got, (0.25, -1.0), w, shares):
        bad, good = np.array([own.get(int(p), (0, 0)) for p in pattern]).T
        p = 1 / (1 + np.exp(-(x @ weights[:6] + bias)))
        error = (bad + good) * p - bad
        assert np.allclose(total[:6], error @ x) and not total[6:-2].any()
        assert np.allclose(total[-2:], [error.sum(), -(bad * np.log(p) + good * np.log(1 - p)).sum()])
    held = spark.sparkContext.broadcast((shares, [(0.0, w[0]), (0.0, w[1])]))
    sizes = [len(r.sums) for r in rows.mapInArrow(Q._gradients(held), "block int, sums binary").collect()]
    assert max(sizes) == 2 * 8 * Q.BLOCK and 16 * max(sizes) < 2 * 8 * Q.DIMENSIONS


def test_scores_are_fitted_by_the_same_jobs(spark, monkeypatch):
    """As one by one, and by no more jobs than the slower of them takes; where rows are all good ones, there is nothing to fit."""
    _, _, rows = some_rows(spark)
    jobs, run = [], Q.gradients
    monkeypatch.setattr(Q, "gradients", lambda rows, shares, points: jobs.append(len(points)) or run(rows, shares, points))
    posteriors = [{0: 0.9, 1: 0.1, 2: 0.02}, {0: 0.0, 1: 0.0, 2: 0.0005}, {0: 0.3, 1: 0.7, 2: 0.6}]
    got, together = Q.fits(rows, posteriors), jobs[:]
    each = []
    for (bias, weights), own in zip(got, posteriors):
        jobs.clear()
        alone = Q.fitted(rows, own)
        each.append(len(jobs))
        assert np.allclose(weights, alone[1], atol=1e-4) and abs(bias - alone[0]) < 1e-4
    assert got[1][0] == -1.0 and not got[1][1].any() and got[0][1].any() and got[2][1].any()
    assert each[1] == 0 and len(together) <= max(each) + 2 and max(together) == 2


def plain(text: bytes) -> tuple[list[bytes], list[bool], set]:
    """Words, junk votes, and features of one text: of words and of classes by name, of steps by statistic."""
    kind = lambda c: ord("a") if chr(c).islower() and c < 128 or c >= 128 else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
    alnum = lambda c: kind(c) in b"aA0"
    tokens = text.split()
    words = [(t[:-1] if t[-1:] in b".,;:!?" else t).lower() for t in tokens]
    n = max(len(tokens), 1)
    solid = b"".join(tokens)
    letters = sum(alnum(c) and c != ord("0") for c in solid)
    parts = [
        sum(not alnum(c) and c not in b".,;:'\"!?()-" for c in solid) / max(len(solid), 1),
        sum(len(t) > 2 and t[-1] == t[-2] and not alnum(t[-1]) for t in tokens) / n,
        sum(kind(c) == ord("A") for c in solid) / max(letters, 1),
        len(set(words)) / n,
        sum(len(t) == 1 and not alnum(t[0]) for t in tokens) / n,
        sum(a == b for a, b in zip(words, words[1:])) / max(n, 10),
    ]
    often = len(tokens) > 20
    junk = [parts[0] > 0.08, parts[1] > 0.2, parts[2] > 0.5 and often, often and parts[3] < 0.1, parts[4] > 0.15, parts[5] > 0.1]
    found = {xxhash.xxh3_64_intdigest(w) % (Q.DIMENSIONS - 4096) + 4096 for w in words}
    found |= {sum(kind(c) << 8 * k for k, c in enumerate(t[:-4:-1])) % 3840 + 256 for t in tokens}
    if tokens:
        found |= {(sum(s < p for s in Q.STEPS) * 2 + often) * 6 + k for k, p in enumerate(parts)}
    return words, junk, found


def test_batches_like_plain_texts():
    """Votes and features of many texts laid end to end, against each text by itself."""
    rng = np.random.default_rng(11)
    bits = ["a", "A", "0", "17", "é", "!", "!!", "***", " ", " ", "\n", "\t", "#", "Z", ",", "you", "idiot", "Idiot!", " x ", "😀", ".", "; ", " word", "\x0b", "WORD ", " "]
    raw = ["".join(rng.choice(bits, rng.integers(0, 90))).encode() for _ in range(300)] + [b"", b" \n", b"!", b"b b b " * 30, b"last"]
    own, given, learned = Q.Batch(raw), Q.hashed(["idiot"]), Q.hashed(["word", "last"])
    votes, (doc, feature), said = own.votes(given, learned), own.features(), own.words
    at = 0
    for k, text in enumerate(raw):
        words, junk, found = plain(text)
        insults = [sum(w == b"idiot" for w in words), sum(w in (b"word", b"last") for w in words)]
        assert votes[k].tolist() == [*map(int, junk), insults[0] > 0, insults[1] > 0, sum(insults) > 1]
        assert feature[doc == k].tolist() == sorted(found)
        assert said[at : at + len(words)].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
        at += len(words)
    assert at == len(said) and (np.diff(doc) >= 0).all()


def test_words_are_taken_without_a_step_for_each():
    """Votes and features together take some 12 times as long as cutting texts into words does; with a slice and a look-up for every word they took 52 times."""
    rng = np.random.default_rng(13)
    words = np.array([f"{chr(97 + k % 26)}word{k * 7919}" for k in range(20_000)])
    raw = [" ".join(rng.choice(words, 400)).encode() for _ in range(150)]
    given, least = Q.hashed(["idiot"]), {"plain": 1e9, "votes": 1e9, "features": 1e9}
    runs = {"plain": lambda: [x.lower().split() for x in raw], "votes": lambda: Q.Batch(raw).votes(given, given), "features": lambda: Q.Batch(raw).features()}
    for _ in range(7):
        for name, run in runs.items():
            began = time.process_time()
            run()
            least[name] = min(least[name], time.process_time() - began)
    assert least["votes"] + least["features"] < 26 * least["plain"]


def test_only_labelled_texts_are_read_for_insults(spark):
    """Spark asked, before the join, of every document whether it has words: by the same expression, once more."""
    docs = spark.createDataFrame([(1, "You scum, you"), (2, "Calm"), (3, "12 34"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    got = Q.labelled_words(docs, Q.labelled(labels))
    assert sorted((r.toxic, r.word) for r in got.collect()) == [(0, "calm"), (1, "scum"), (1, "you")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
