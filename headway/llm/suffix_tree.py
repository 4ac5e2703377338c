"""Substring dedup of word passages, by prefix-partitioned suffix trees.

The suffixes (window starts) of blocks whose anchor recurs (see repeats) are split, in their bucket's
task, by prefixes of variable length: one word, and longer where a group is larger than memory allows.
Each group's subtree is grown from its prefix, a word at a level, and branches with one suffix are left;
internal nodes as deep as the window are the passages that repeat.

Words are runs of bytes other than blanks (hexadecimal 20, 09 to 0D), unchanged, and count as their 64-bit
xxh3 hashes; null text has none. Identical blocks count as one entry of the trees (a 128-bit digest tells them;
see repeats). Only documents with a smaller doc_id count, so rows that repeat a doc_id don't remove from each
other, and a null doc_id counts as the smallest. Extra columns are carried on request. Very long texts and words
are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import repeats
from headway.llm.common import table

WORDS = 50
#: Suffixes of a subtree that is grown at once.
SUBTREE = 100_000
#: Words whose hashes a task keeps at once.
KNOWN = 50_000


class Words(dict):
    """The hash of each word, once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def units(raw: list[bytes]) -> list[np.ndarray]:
    """A hash for each word of each text."""
    out = []
    for x in raw:
        w = x.split()
        out.append(np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w)))
    return out


def mixed(units_: np.ndarray) -> np.ndarray:
    return units_


def prefix_groups(words: np.ndarray, starts: np.ndarray, length: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(depth, suffixes) groups that share a prefix of depth words, each of most suffixes at most unless it is length deep."""
    out, todo = [], [(0, starts)]
    while todo:
        depth, p = todo.pop()
        if len(p) <= most and depth or depth == length:
            out.append((depth, p))
            continue
        order = np.argsort(words[p + depth], kind="stable")
        p = p[order]
        cut = np.flatnonzero(np.diff(words[p + depth])) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(p)]]))
        small = np.repeat(sizes <= most, sizes)  # prefixes that are small enough share a pass, as separate subtrees
        if small.any():
            out.append((depth + 1, p[small]))
        todo += [(depth + 1, x) for x, n in zip(np.split(p, cut), sizes) if n > most]
    return out


def groups(units_: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, most: int = SUBTREE) -> np.ndarray:
    """A number for each suffix start; equal where the suffixes share an internal node of depth length."""
    words = np.unique(units_, return_inverse=True)[1]
    n_words, seen = int(words.max(initial=0)) + 1, 0
    out = np.empty(len(words), np.int64)
    for depth, p in prefix_groups(words, starts, length, most):
        # a node for each different prefix so far
        node = np.zeros(len(p), np.int64)
        for d in range(min(depth, 1)):
            node = words[p + d].astype(np.int64)
        if depth > 1:
            node[:] = 0
            for d in range(depth):
                node = np.unique(node * n_words + words[p + d], return_inverse=True)[1]
        out[p] = seen + np.arange(len(p))  # leaves, until a deep node is found
        live = np.arange(len(p))
        for d in range(depth, length + 1):
            node, count = np.unique(node, return_inverse=True, return_counts=True)[1:]
            shared = count[node] > 1
            live, node = live[shared], node[shared]
            if d == length or not len(live):
                break
            node = node.astype(np.int64) * n_words + words[p[live] + d]
        if len(live):
            out[p[live]] = seen + len(p) + node
        seen += 2 * len(p) + 1
    return out[starts]


def _cut(raw: list[bytes], spans: list[np.ndarray]) -> dict:
    kept, n, gone = [], [], []
    for x, s in zip(raw, spans):
        w = x.split()
        edges = [0, *np.column_stack([s["start"], s["end"]]).ravel().tolist(), len(w)]
        own = [y for a, b in zip(edges[::2], edges[1::2]) for y in w[a:b]]
        kept.append(b" ".join(own))
        n.append(len(w))
        gone.append(len(w) - len(own))
    return {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary())}


def dedup(docs: DataFrame, words: int = WORDS, carried: list[str] = (), **more) -> DataFrame:
    """doc_id, n_words, n_removed and the words kept (joined by a blank, UTF-8 bytes): every word of a passage of so many words that a smaller doc_id has is gone."""
    plan = repeats.Plan(units=units, mixed=mixed, groups=groups, length=words, gram=max(1, words // 3), same_doc=False, **more)
    return repeats.removed(docs, plan, _cut, "n_words long, n_removed long, kept binary", list(carried))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_tree": op10_suffix_tree}
ORACLES: dict[str, str] = {}
