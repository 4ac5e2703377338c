"""Quality classifier by weak labels.

Heuristic labellers vote on each document, some on junk (symbols, shouting, repetition, separators) and some
on toxicity (insults: a given list and words that labelled rows show). They overlap and err; for each of
the two, expectation-maximisation over the counts of vote patterns estimates how often each labeller is
right, and so the posterior of each pattern. Those posteriors are the labels of a linear scorer over hashed features: the words
of a text, the classes of their last three characters, and statistics of the text in steps. It is a regularised logistic
regression, whose gradients Spark sums; it alone decides, the votes have no part in a score. A document that either score finds bad is rejected.

Votes are counted over all documents, texts of the same digest once. The scorer is fitted to MAX_FITTED different texts at most, an equal part
of those found junk, found toxic and found neither, each by least digest; the insult words come from MAX_LABELLED labelled rows at most, by hash (ties by
doc_id), all that qualify (ties don't matter: no number of words is set). Features are hashed to DIMENSIONS numbers. Without labelled rows the
given list stands alone; where no document is found bad, none is rejected. Null, empty and blank texts have no features: their scores are the scorer's bias.
Rows that repeat a doc_id, or have none, are judged each by its own text, very long ones whole; other columns are ignored, or kept by `filtered`;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import freeing, slices, stage, table, texts

#: Labelled rows that the insult words are read from.
MAX_LABELLED = 20_000
#: Different texts that the scorer is fitted to.
MAX_FITTED = 20_000
DIMENSIONS = 2**17
#: Weight of the squared weights in what the fit makes small, and its rounds.
PENALTY, ROUNDS = 1e-5, 40
#: Features whose gradients travel as one piece.
BLOCK = 4096
#: Steps of a text's statistics.
STEPS = np.array([0.02, 0.05, 0.08, 0.12, 0.2, 0.35, 0.5, 0.75, 0.9])
#: Common insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "pathetic", "scum", "worthless", "disgusting", "trash", "clown", "imbecile")
JUNK = ("symbols", "marked", "shouting", "repeats", "separators", "runs")
TOXIC = ("insult", "learned", "insults")
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91], _CLASS[48:58] = 65, 48
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ALNUM = np.isin(_CLASS, [97, 65, 48])
_SYMBOL = ~_ALNUM & ~_BLANK & ~np.isin(np.arange(256), [*b".,;:'\"!?()-"])
_LETTER = (_CLASS != np.arange(256)) | np.isin(np.arange(256), [97, 65])
_BEHIND = np.isin(np.arange(256), [*b".,;:!?"])
#: What a byte is, as bits, and tables for bytes.translate: that is several times as fast as an index by bytes.
BLANK, SYMBOL, UPPER, LETTER = 1, 2, 4, 8
_KINDS = (_BLANK * BLANK | _SYMBOL * SYMBOL | (_CLASS == 65) * UPPER | _LETTER * LETTER).astype(np.uint8).tobytes()
#: Numbers of features below the words'.
FIXED = 64 * 64


class Batch:
    """Words, shapes and statistics of a batch of texts, laid end to end. Each different word is hashed once."""

    def __init__(self, raw: list[bytes]):
        from xxhash import xxh3_64_intdigest

        joined = b"\n".join(raw) + b"\n"
        body, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
        blank = (kinds & BLANK) != 0
        before = np.concatenate([[True], blank[:-1]])
        start, end = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        n_words = np.diff(np.searchsorted(start, ends), prepend=0)
        self.n, self.n_words, self.of = len(raw), n_words, np.repeat(np.arange(len(raw)), n_words)
        # words without punctuation behind them
        last = body[end - 1]
        behind = _BEHIND[last]
        kept = ~blank
        kept[end[behind] - 1] = False
        offsets = np.concatenate([[0], np.cumsum(end - start - behind)]).astype(np.int32)
        low = np.compress(kept, np.frombuffer(joined.lower(), np.uint8))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False)
        self.hashes, self.code = np.fromiter(map(xxh3_64_intdigest, different), U, len(different)), coded.indices.to_numpy()
        self._body, self._start, self._end = body, start, end

        def per(kind):
            own = (kinds & kind) != 0
            return np.array([np.count_nonzero(own[a:b]) for a, b in zip(begins.tolist(), (ends - 1).tolist())], np.int64)

        chars, some = np.maximum(sizes - per(BLANK), 1), np.maximum(n_words, 1)
        count = lambda m: np.bincount(self.of[m], minlength=self.n)
        double = ~_ALNUM[last] & (end - start > 2)
        double[double] = body[end[double] - 2] == last[double]
        alone = (end - start == 1) & ~_ALNUM[last]
        # each word of a document once
        pair = distinct(self.of * len(different) + self.code)
        self._word_of, self._word = pair // max(len(different), 1), pair % max(len(different), 1)
        self._often = n_words > 20
        same = np.concatenate([[False], (self.code[1:] == self.code[:-1]) & (self.of[1:] == self.of[:-1])])[: len(start)]
        # parts of: symbols, doubled signs, capitals, different words, signs that stand alone, words said twice
        self._parts = np.stack([
            per(SYMBOL) / chars, count(double) / some, per(UPPER) / np.maximum(per(LETTER), 1),
            np.bincount(self._word_of, minlength=self.n) / some, count(alone) / some, count(same) / np.maximum(some, 10),
        ], axis=1)

    @property
    def words(self) -> np.ndarray:
        """The hash of each word."""
        return self.hashes[self.code]

    def votes(self, given: np.ndarray, learned: np.ndarray) -> np.ndarray:
        parts, often = self._parts, self._often
        junk = [parts[:, 0] > 0.08, parts[:, 1] > 0.2, (parts[:, 2] > 0.5) & often, often & (parts[:, 3] < 0.1), parts[:, 4] > 0.15, parts[:, 5] > 0.1]
        return np.concatenate([np.stack(junk, axis=1), self.toxic(given, learned)], axis=1).astype(np.int64)

    def toxic(self, given: np.ndarray, learned: np.ndarray) -> np.ndarray:
        known, read = np.isin(self.hashes, given), np.isin(self.hashes, learned)
        count = lambda m: np.bincount(self.of[m[self.code]], minlength=self.n)
        return np.stack([count(known) > 0, count(read) > 0, count(known | read) > 1], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and feature, each pair once. Classes and steps stand below the words' numbers, of which there are the rest."""
        end, length = self._end, self._end - self._start
        at = lambda k: np.where(length >= k, _CLASS[self._body[np.maximum(end - k, 0)]], 0).astype(np.uint32)
        shape = (at(1) | at(2) << np.uint32(8) | at(3) << np.uint32(16)) % np.uint32(FIXED - 256)
        fixed = np.zeros((self.n, FIXED), bool)
        fixed[self.of, shape + np.uint32(256)] = True
        # a step for each statistic, with whether the text is long enough to tell
        steps = (np.searchsorted(STEPS, self._parts) * 2 + self._often[:, None]) * self._parts.shape[1] + np.arange(self._parts.shape[1])
        some = np.flatnonzero(self.n_words)
        fixed[some[:, None], steps[some]] = True
        doc, low = np.nonzero(fixed)
        number = (self.hashes % U(DIMENSIONS - FIXED) + U(FIXED)).astype(np.int64)
        pair = distinct(np.concatenate([doc * DIMENSIONS + low, self._word_of * DIMENSIONS + number[self._word]]))
        return pair // DIMENSIONS, pair % DIMENSIONS


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in ascending order: a sort takes less time than np.unique's table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def hashed(words: list[str]) -> np.ndarray:
    return Batch([w.encode() for w in words]).words if words else np.zeros(0, U)


def labelled(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and toxic of a bounded number of labelled rows."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return some.orderBy(F.xxhash64("doc_id"), "toxic").limit(most).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled_words(docs: DataFrame, some: DataFrame) -> DataFrame:
    """toxic, group and word of each labelled row: its words once each."""
    rows = texts(docs).join(F.broadcast(some), "doc_id")  # `most` rows of two numbers
    words = rows.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']+"), F.lit(0))).alias("w"))
    # near copies mostly share their least word hash, and count once
    words = words.select("toxic", F.array_min(F.transform("w", lambda x: F.xxhash64(x))).alias("group"), "w")
    # a plain explode lets Spark ask all documents, before the join, whether they have words
    return words.select("toxic", "group", F.explode_outer("w").alias("word")).where("word IS NOT NULL")


def insult_words(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[str]:
    """Words that toxic rows have and others hardly have, from a bounded number of labelled rows."""
    some = labelled(labels, most)
    n = {r.toxic: r.n for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    counts = labelled_words(docs, some).groupBy("word").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("group"))).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    chosen = counts.where((F.col("a") >= max(3, 0.01 * n[1])) & (F.col("a") / n[1] > 200 * F.col("b") / n[0]))
    return [r.word for r in chosen.orderBy("word").collect()]


def em(counts: dict[int, int], labellers: int, rounds: int = 100) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and each labeller's rates of votes on bad and on good documents."""
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    v = (codes[:, None] >> np.arange(labellers)) & 1
    post = np.where(v.sum(axis=1) > 0, 0.9, 0.001)
    for _ in range(rounds):
        bad, good = n * post, n * (1 - post)
        prior = (bad.sum() + 1) / (n.sum() + 20)
        hit = np.clip((bad @ v + 1) / (bad.sum() + 2), 1e-4, 1 - 1e-4)
        false = np.clip((good @ v + 0.01) / (good.sum() + 2), 1e-4, 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + v @ np.log(hit / false) + (1 - v) @ np.log((1 - hit) / (1 - false))
        new = 1 / (1 + np.exp(-odds))
        new[v.sum(axis=1) == 0] = np.minimum(new[v.sum(axis=1) == 0], 0.01)  # no vote is no evidence
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return dict(zip(codes.tolist(), post.tolist())), hit, false


def _voted(given: np.ndarray, learned: np.ndarray):
    """The vote pattern of each text, beside its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=400_000):
            votes = Batch(b.column("text").cast(pa.binary()).to_pylist()).votes(given, learned) @ (1 << np.arange(len(JUNK) + len(TOXIC)))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(votes.astype(np.int32))], ["digest", "pattern"])

    return run


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text, as one list."""
    for b in slices(batches, size=400_000):
        own = Batch(b.column("text").cast(pa.binary()).to_pylist())
        doc, feature = own.features()
        ends = np.searchsorted(doc, np.arange(own.n + 1))
        yield pa.RecordBatch.from_arrays([b.column("pattern"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))], ["pattern", "features"])


def lower(point: np.ndarray, rounds: int, pairs: int = 10):
    """Limited-memory BFGS with halved steps, as a generator: yields points, is sent value and gradient there, and returns the lowest."""
    value, slope = yield point
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ way))
            way -= kept[-1] * y
        if past:
            s, y, r = past[-1]
            way /= r * (y @ y)
        for (s, y, r), k in zip(past, reversed(kept)):
            way += (k - r * (y @ way)) * s
        fall = way @ slope
        if not fall < 0:
            break
        step = 1.0 if past else 1 / np.sqrt(-fall)
        for _ in range(30):
            new_value, new_slope = yield point + step * way
            if new_value <= value + 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        s, y, gain = step * way, new_slope - slope, value - new_value
        point, value, slope = point + s, new_value, new_slope
        if gain <= 1e-9 * abs(value):
            break
        if s @ y > 0:
            past = [*past[1 - pairs :], (s, y, 1 / (s @ y))]
    return point


def _gradients(held):
    """Blocks of a partition's sums for each score: by feature those of the errors of its rows, then of errors, then of losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, points = held.value
        sums = np.zeros((len(points), DIMENSIONS + 2))
        for b in batches:
            lists = b.column("features")
            feature, doc = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            for (bias, weights), total, own in zip(points, sums, shares):
                bad, good = np.array([own.get(p, (0.0, 0.0)) for p in b.column("pattern").to_pylist()]).reshape(-1, 2).T
                margin = bias + np.bincount(doc, weights=weights[feature], minlength=b.num_rows)
                losses, others = np.logaddexp(0, -margin), np.logaddexp(0, margin)
                error = (bad + good) * np.exp(-losses) - bad
                total[:DIMENSIONS] += np.bincount(feature, weights=error[doc], minlength=DIMENSIONS)
                total[DIMENSIONS:] += error.sum(), bad @ losses + good @ others
        at = range(0, DIMENSIONS + 2, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([np.ascontiguousarray(sums[:, k : k + BLOCK]).tobytes() for k in at], pa.binary())], ["block", "sums"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = 0.0
    for x in t.column("sums"):
        total = total + np.frombuffer(x.as_buffer())
    return pa.table([t.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])


def gradients(rows: DataFrame, shares: list[dict], points: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """For each score, by one job: sums of errors by feature, of errors, and of losses at its point. Tasks add them up by blocks, so that
    the driver gets one array of DIMENSIONS + 2 numbers for each score, in small pieces. shares: of each pattern, bad and good."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((shares, points))
    with freeing(spark):
        got = rows.mapInArrow(_gradients(held), "block int, sums binary").groupBy("block").applyInArrow(_added, "block int, sums binary").collect()
    held.destroy()
    blocks = [np.frombuffer(r.sums).reshape(len(points), -1) for r in sorted(got, key=lambda r: r.block)]
    return np.concatenate(blocks, axis=1) if blocks else np.zeros((len(points), DIMENSIONS + 2))


def fits(rows: DataFrame, posteriors: list[dict[int, float]]) -> list[tuple[float, np.ndarray]]:
    """Bias and weights of a logistic regression for each of the posteriors, on rows of pattern and features, where a row is bad with its
    pattern's posterior: it takes part as a bad one and as a good one, by these weights. All are fitted side by side: a job of Spark sums the gradients
    of all at the points that they ask for. Steps are taken in the driver's Python: vectors of a megabyte that many rounds throw away would
    fill the heap of its JVM."""
    n = {r.pattern: r.n for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 512 at most
    shares = [{int(p): tuple(x if x > 0.001 else 0.0 for x in (float(q), 1 - float(q))) for p, q in own.items()} for own in posteriors]
    of = [[sum(n[p] * x[k] for p, x in own.items() if p in n) for k in (0, 1)] for own in shares]
    out = [(-1.0, np.zeros(DIMENSIONS))] * len(shares)
    todo = [k for k, (bad, good) in enumerate(of) if bad > 0 and good > 0]
    if not todo:
        return out
    # errors of a half where every row is a good one: half the rows with each feature
    half = gradients(rows, [{p: (0.0, 1.0) for p in n}], [(0.0, np.zeros(DIMENSIONS))])[0]
    mean = half[:DIMENSIONS] / half[DIMENSIONS]
    # steps are taken on centred features of equal spread; those that all rows have, or none, stay out
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
    scale = np.divide(1, spread, out=np.zeros(DIMENSIONS), where=spread > 1e-9)

    def plain(point: np.ndarray) -> tuple[float, np.ndarray]:
        weights = point[:-1] * scale
        return float(point[-1] - mean @ weights), weights

    runs = {k: lower(np.append(np.zeros(DIMENSIONS), np.log(of[k][0] / of[k][1])), ROUNDS) for k in todo}
    asked = {k: next(run) for k, run in runs.items()}
    while asked:
        points = {k: plain(x) for k, x in asked.items()}
        for k, total in zip(points, gradients(rows, [shares[k] for k in points], list(points.values()))):
            weights, size = points[k][1], sum(of[k])
            slope = np.append(((total[:DIMENSIONS] - mean * total[DIMENSIONS]) / size + PENALTY * weights) * scale, total[DIMENSIONS] / size)
            try:
                asked[k] = runs[k].send((total[-1] / size + PENALTY / 2 * (weights @ weights), slope))
            except StopIteration as end:
                out[k] = plain(end.value)
                del asked[k]
    return out


def fitted(rows: DataFrame, posterior: dict[int, float]) -> tuple[float, np.ndarray]:
    """One of `fits`."""
    return fits(rows, [posterior])[0]


def train(docs: DataFrame, labels: DataFrame | None, most: int = MAX_FITTED) -> dict:
    """The scorer: for each of junk and toxicity a bias and weights, with the labellers' estimated rates."""
    learned = insult_words(docs, labels) if labels is not None else []
    words = hashed(list(INSULTS)), hashed(learned)
    digested = texts(docs).select("text").withColumn("digest", F.xxhash64("text"))
    seen = stage(digested.mapInArrow(_voted(*words), "digest long, pattern int").groupBy("digest").agg(F.min("pattern").alias("pattern")))
    patterns = {r.pattern: r.n for r in seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 512 at most
    out, posts = {"words": words, "learned": learned}, {}
    for name, first, k in (("junk", 0, len(JUNK)), ("toxic", len(JUNK), len(TOXIC))):
        own: dict[int, int] = {}
        for p, n in patterns.items():
            c = p >> first & (1 << k) - 1
            own[c] = own.get(c, 0) + n
        post, hit, false = em(own, k)
        posts[name] = {p: post[p >> first & (1 << k) - 1] for p in patterns}
        out[name] = {"hit": hit, "false": false, "posterior": post}
    kind = {p: 0 if posts["junk"][p] > 0.5 else 1 if posts["toxic"][p] > 0.5 else 2 for p in patterns}
    rows = docs.sparkSession.createDataFrame([], "pattern int, features array<int>")
    if patterns:
        chosen = [seen.where(F.col("pattern").isin([p for p in kind if kind[p] == c])).orderBy(F.xxhash64("digest"), "digest").limit(most // 3) for c in range(3)]
        chosen = stage(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]))
        # `most` digests, and a copy of each text that has one
        picked = digested.join(F.broadcast(chosen), "digest").groupBy("digest").agg(F.first("pattern").alias("pattern"), F.first("text").alias("text"))
        rows = stage(picked.select("pattern", "text").mapInArrow(_featured, "pattern int, features array<int>"))
    for name, (bias, weights) in zip(posts, fits(rows, list(posts.values()))):
        out[name]["bias"], out[name]["weights"] = bias, weights
    return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, size=400_000):
            own = Batch(b.column(1).cast(pa.binary()).to_pylist())
            doc, feature = own.features()
            s = [h["bias"] + np.bincount(doc, weights=h["weights"][feature], minlength=own.n) for h in (m["junk"], m["toxic"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s[0]), pa.array(s[1])], ["doc_id", "text", "junk_score", "toxic_score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, junk_score, toxic_score, kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights of each score
    rows = texts(docs).mapInArrow(_score(held), "doc_id long, text string, junk_score double, toxic_score double")
    return rows.withColumn("kept", (F.col("junk_score") <= 0) & (F.col("toxic_score") <= 0))


def filtered(docs: DataFrame, model: dict) -> DataFrame:
    """The rows that are kept, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    run, schema = _score(held), docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("text").fill_null("")], ["doc_id", "text"])
            parts = list(run(iter([own])))
            bad = [(x.column("junk_score").to_numpy() > 0) | (x.column("toxic_score").to_numpy() > 0) for x in parts]
            if parts:
                yield b.filter(pa.array(~np.concatenate(bad)))

    return docs.mapInArrow(rows, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
