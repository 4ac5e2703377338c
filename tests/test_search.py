"""Place search against a scan of all places with the same scores."""

import re
from difflib import SequenceMatcher

from hypothesis import given, settings, strategies as st

from headway.operators import search as X
from headway.sources.stages import stage


def alike(word, other):
    if other.startswith(word):
        return 1.0
    if word in other:
        return 0.9
    return 0.0 if abs(len(word) - len(other)) > 3 else SequenceMatcher(None, word, other).ratio()


def scan(places, text, limit=20):
    """Few places and words: nothing is cut, so each place is judged by all its words."""
    typed = re.findall(r"\w+", text.lower())
    vocab = {}
    words = {}
    for p, display, *_ in places:
        name, _, context = display.partition(" (")
        words[p] = set(re.findall(r"\w+", name.lower())), set(re.findall(r"\w+", context.lower()))
        for named, own in zip((True, False), words[p]):
            for w in own:
                vocab.setdefault(w, set()).add(p)
    found = {}
    for j, t in enumerate(typed):
        could = {w: (1.0, w == t) for w in vocab if w.startswith(t)}
        if sum(len(vocab[w]) for w in could) < 50 and len(t) >= 6:
            probe = t[: max(3, len(t) - 2)]
            could |= {w: (alike(t, w), False) for w in vocab if w not in could and probe in w and alike(t, w) >= 0.6}
        for p, (name, context) in words.items():
            options = [(s, e, True) for w, (s, e) in could.items() if w in name] + [(s - 0.01, False, False) for w, (s, e) in could.items() if w in context]
            if options:
                found.setdefault(p, {})[j] = max(options)
    out, part = [], []
    for p, got in found.items():
        b = [got.get(j, (0.0, False, False)) for j in range(len(typed))]
        if min(x[0] for x in b) >= 0.6:
            out.append((p, b))
        elif max(x[0] for x in b) >= 0.6:
            part.append((p, b))
    if len(out) < limit:
        for p, b in part:
            b = [x if x[0] >= 0.6 else (max((alike(t, w) for own in words[p] for w in own if w[0] == t[0]), default=0.0), *x[1:]) for t, x in zip(typed, b)]
            if min(x[0] for x in b) >= 0.6:
                out.append((p, b))
    at = {p: (display.partition(" (")[0], category) for p, display, category, *_ in places}
    rows = [(-sum(x[1] for x in b), -(at[p][1].startswith("place=")), -sum(x[0] for x in b) / len(b), at[p][0], p) for p, b in out]
    return [(p, round(-s, 9), -e) for e, _, s, _, p in sorted(rows)][:limit]


NAMES = ["Shevchenka avenue (Lviv, Center)", "Shevchenkivskyi park (Lviv)", "Slavske (Stryi)", "Hotel Slavske (Slavske, Stryi)", "Stryiska street (Lviv)", "Stryi (oblast)", "Railway station (Lviv)", "Railway depot (Stryiska street)", "Market square (Lviv, Center)", "Center (Stryi)", "Cafe Center (Shevchenka avenue)", "15 km (Stryi)"]
ASKED = ["slavske", "slavsko", "stryi", "center lviv", "shevchenko avenue", "railwy station", "stryjska street", "market", "nothing", "", "15", "cafe shevchenka", "statoin railway", "s", None]


def test_like_a_scan(spark):
    places = [(k, n, "place=town" if k in (2, 5) else "highway=residential", 49.8, 24.0) for k, n in enumerate(NAMES * 2)]
    ix = X.index(spark.createDataFrame(places, "place long, display string, category string, lat double, lon double"), stage)
    queries = spark.createDataFrame([(q, t, None, None) for q, t in enumerate(ASKED)], "q long, text string, lat double, lon double")
    got = {}
    for r in X.search(queries, ix, stage).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.place, round(r.score, 9), r.exact))
    some = 0
    for q, t in enumerate(ASKED):
        want = scan(places, t or "")
        assert got.get(q, []) == want, t
        some += bool(want)
    assert some > 9


def test_distance_orders_equal_hits(spark):
    places = [(k, "Stop (Lviv)", "x=y", 49.8 + k / 100, 24.0) for k in range(6)]
    ix = X.index(spark.createDataFrame(places, "place long, display string, category string, lat double, lon double"), stage)
    queries = spark.createDataFrame([(1, "stop", 49.829, 24.0), (2, "stop", None, None)], "q long, text string, lat double, lon double")
    rows = X.search(queries, ix, stage, 4).orderBy("q", "rank").collect()
    assert [r.place for r in rows if r.q == 1][0] == 3 and len(rows) == 8
    assert {r.place for r in rows if r.q == 1} == {1, 2, 3, 4}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40)))
def test_postings_round_trip(refs):
    assert X.delta_decoded(X.delta_coded(sorted(refs))) == sorted(refs)
