"""Evaluation texts inside a corpus, by multi-pattern search after Wu and Manber.

The patterns are short word windows of the held-out items.  A shift table over
blocks of characters tells how far a position can be from the end of any
pattern, so most positions are never looked at; where the shift is 0, the
block's hash selects a bucket of patterns and the characters are compared
directly.  Texts are scanned in lanes that move in lockstep, which keeps the
scan inside numpy.  Documents with occurrences are then aligned with the items
word by word, so that passages out of order or with single words changed count,
and texts from the same sentence frame with other facts don't.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pictorium.llm.plaintext import words
from pictorium.runtime import spread

WINDOW = 3
BLOCK = 5
LEAST = 14
#: Width of a lane; lanes overlap by nothing, as a lane owns the ends of its occurrences.
LANE = 128
SHARE = 1 / 3
QUOTE = 10
#: A passage matches by at least this share of its words, weighed by how rare they are among the items.
ALIKE = 0.62
#: Bits of the shift table; from many patterns on it grows, so that most of its places stay free.
TABLE_BITS, MOST_BITS, FREE = 20, 26, 16
#: Items that one pass over the documents looks for.
ITEMS_AT_ONCE = 200_000
#: Characters that one pass of the scanner takes together.
AT_ONCE = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Hash of the BLOCK characters that end at each of ``ends``."""
    h = np.zeros(len(ends), np.uint64)
    for k in range(BLOCK - 1, -1, -1):
        h = (h ^ codes[ends - k]) * _MULTIPLIER
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class WuManber:
    """Finds all occurrences of many strings of at least ``least`` characters."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.least = min((len(p) for p in patterns), default=0)
        if patterns and self.least < BLOCK:
            raise ValueError("a pattern is shorter than a block")
        m = self.least
        blocks = len(patterns) * max(m - BLOCK + 1, 1)
        self.bits = min(MOST_BITS, max(TABLE_BITS, (FREE * blocks).bit_length()))
        self.shift = np.full(1 << self.bits, max(m - BLOCK + 1, 1), np.int32)
        self.bucket: dict[int, list[int]] = defaultdict(list)
        for number, pattern in enumerate(patterns):
            codes = _codes(pattern)
            ends = np.arange(BLOCK - 1, m)
            slots = _hash(codes, ends, self.bits)
            np.minimum.at(self.shift, slots, (m - 1 - ends).astype(np.int32))
            self.bucket[int(slots[-1])].append(number)

    def ends_of_blocks(self, codes: np.ndarray) -> np.ndarray:
        """Positions where the first ``least`` characters of some pattern may end."""
        m = self.least
        at = np.arange(m - 1, len(codes), LANE)
        stop = np.minimum(at + LANE, len(codes))
        hits = []
        while len(at):
            step = self.shift[_hash(codes, at, self.bits)]
            zero = step == 0
            hits.append(at[zero])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(hits)) if hits else np.empty(0, np.int64)

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and patterns of every occurrence, in order of the start."""
        starts, numbers = [], []
        if self.patterns and len(text) >= self.least:
            codes = _codes(text)
            ends = self.ends_of_blocks(codes)
            for end, slot in zip(ends.tolist(), _hash(codes, ends, self.bits).tolist()):
                start = end - self.least + 1
                for number in self.bucket.get(slot, ()):
                    if text.startswith(self.patterns[number], start):
                        starts.append(start)
                        numbers.append(number)
        return np.asarray(starts, np.int64), np.asarray(numbers, np.int64)


@dataclass
class Items:
    """Held-out items prepared for the search; there are few of them and they are the broadcast side."""

    ids: list[int]
    tokens: list[list[str]]
    weight: dict[str, float] = field(default_factory=dict)
    search: WuManber | None = None
    places: list[list[tuple[int, int]]] = field(default_factory=list)

    @staticmethod
    def prepare(rows: list[tuple[int, str]]) -> "Items":
        items = Items([r[0] for r in rows], [words(r[1] or "") for r in rows])
        df = Counter(w for t in items.tokens for w in set(t))
        n = max(2, len(rows))
        items.weight = {w: math.log(1 + n / k) for w, k in df.items()}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, tokens in enumerate(items.tokens):
            for k in range(len(tokens)):
                stop = k + WINDOW
                while stop < len(tokens) and len(" ".join(tokens[k:stop])) + 2 < LEAST:
                    stop += 1
                pattern = " " + " ".join(tokens[k:stop]) + " "
                if stop <= len(tokens) and len(pattern) >= LEAST:
                    at[pattern].append((number, k))
        items.search = WuManber(list(at))
        items.places = list(at.values())
        return items

    def passages(self, number: int, tokens: list[str], anchors: list[tuple[int, int]], least: int = 1) -> set[int]:
        """Word positions of the item that the text reproduces in passages; none if there can't be ``least``."""
        item, covered = self.tokens[number], set()
        runs: list[list[tuple[int, int]]] = []
        for i, j in sorted(anchors, key=lambda a: (a[0] - a[1], a[0])):
            if runs and abs((i - j) - (runs[-1][-1][0] - runs[-1][-1][1])) <= 2 and 0 < i - runs[-1][-1][0] <= 12:
                runs[-1].append((i, j))
            else:
                runs.append([(i, j)])
        spans = []
        for run in runs:
            low = min(i - j for i, j in run)
            high = max(i - j for i, j in run)
            j0, j1 = max(0, min(j for _, j in run) - 12), min(len(item), max(j for _, j in run) + WINDOW + 12)
            spans.append((max(0, j0 + low - 4), min(len(tokens), j1 + high + 4), j0, j1))
        spans = list(dict.fromkeys(spans))
        # Only words of the item that occur in the span's part of the text can be covered.
        near = [set(tokens[i0:i1]) for i0, i1, _, _ in spans]
        if len({j for (_, _, j0, j1), words_ in zip(spans, near) for j in range(j0, j1) if item[j] in words_}) < least:
            return covered
        for i0, i1, j0, j1 in spans:
            blocks = SequenceMatcher(None, tokens[i0:i1], item[j0:j1], autojunk=False).get_matching_blocks()
            pairs = [(i0 + b.a + k, j0 + b.b + k) for b in blocks for k in range(b.size)]
            covered |= self._dense(item, pairs)
        return covered

    def _dense(self, item: list[str], pairs: list[tuple[int, int]]) -> set[int]:
        """Of aligned words, those in stretches where most of the item's weight is matched."""
        out: set[int] = set()
        stretch: list[tuple[int, int]] = []
        for pair in [*pairs, (1 << 40, 1 << 40)]:
            if stretch and (pair[0] - stretch[-1][0] > 4 or pair[1] - stretch[-1][1] > 4):
                out |= self._trimmed(item, stretch)
                stretch = []
            stretch.append(pair)
        return out

    def _trimmed(self, item: list[str], stretch: list[tuple[int, int]]) -> set[int]:
        """The sub-stretch with the most weight matched less weight missed."""
        gain = []
        for k, (i, j) in enumerate(stretch):
            cost = 0.0
            if k:
                missed = range(stretch[k - 1][1] + 1, j)
                added = i - stretch[k - 1][0] - 1 - len(missed)
                cost = sum(self.weight.get(item[x], 0.0) for x in missed) + max(0, added) * 0.5
            gain.append((self.weight.get(item[j], 0.0), cost))
        # A missed weight counts so that a stretch is worth keeping above the share ALIKE.
        rate = ALIKE / (1 - ALIKE)
        best, best_span, total, start = 0.0, None, 0.0, 0
        for k, (won, lost) in enumerate(gain):
            if total - lost * rate <= 0:
                total, start = 0.0, k
            else:
                total -= lost * rate
            total += won
            if total > best:
                best, best_span = total, (start, k)
        if best_span is None:
            return set()
        kept = {stretch[k][1] for k in range(best_span[0], best_span[1] + 1)}
        return kept if len(kept) >= 4 else set()

    def leaked(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, item id, words covered, words of the item) of the items that the texts carry."""
        held: list[list[str]] = []
        size = first = 0
        for number, text in enumerate(texts):
            held.append(words(text) if text else [])
            size += len(text or "")
            if size >= AT_ONCE or number == len(texts) - 1:
                yield from self._scan(held, first)
                held, size, first = [], 0, number + 1

    def _scan(self, held: list[list[str]], first: int) -> Iterator[tuple[int, int, int, int]]:
        # The line end between two texts is part of no pattern.
        plain = [" " + " ".join(tokens) + " " for tokens in held]
        begins = np.cumsum([0] + [len(p) + 1 for p in plain])
        starts, patterns = self.search.find("\n".join(plain))
        owner = np.searchsorted(begins, starts, side="right") - 1
        for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(owner)) + 1):
            if len(at):
                text = int(owner[at[0]])
                for hit in self._aligned(held[text], (starts[at] - begins[text]).tolist(), patterns[at].tolist()):
                    yield (first + text, *hit)

    def _aligned(self, tokens: list[str], starts: list[int], patterns: list[int]) -> Iterator[tuple[int, int, int]]:
        begins = np.cumsum([0] + [len(t) + 1 for t in tokens])
        anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for word, pattern in zip(np.searchsorted(begins, starts).tolist(), patterns):
            for number, k in self.places[pattern]:
                anchors[number].append((word, k))
        for number, found in anchors.items():
            length = len(self.tokens[number])
            least = max(QUOTE, math.ceil(length * SHARE - 1e-9))
            # Only words of the item that occur in the text can be covered.
            if len(tokens) < least or not self._enough(number, tokens, found, least):
                continue
            covered = len(self.passages(number, tokens, found, least))
            if covered >= least:
                yield self.ids[number], covered, length

    def _enough(self, number: int, tokens: list[str], found: list[tuple[int, int]], least: int) -> bool:
        """Whether a rare word of the item is near an anchor; a text of the same frame has none."""
        near: set[int] = set()
        for i, j in found:
            near.update(range(j, j + WINDOW))
        rare = self.weight
        item = self.tokens[number]
        return sum(rare.get(item[j], 0.0) for j in near if j < len(item)) >= 4.0


def leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, words_found, item_words): documents that carry an item, wholly or in part.

    A document carries an item if it reproduces at least ten and at least a
    third of the item's words in passages.  Spelling in other scripts, markup,
    layout, the order of passages and single changed words make no difference.

    Defined results: NULL and empty texts carry nothing; rows without a key are
    passed over; repeated rows give repeated results; items of fewer than ten
    words can't leak.  The items are the stated query set: they are broadcast in
    blocks of about ``at_once``, each of which goes over the documents once.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item).cast("bigint").alias("id"), F.col(item_text).alias("body")).where("id is not null and body is not null").distinct()
    blocks = max(1, -(-wanted.count() // at_once))

    def scan(batches: Iterator[pd.DataFrame], prepared) -> Iterator[pd.DataFrame]:
        held = prepared.value
        for frame in batches:
            keys = frame["key"].tolist()
            out = [(keys[k], *hit) for k, *hit in held.leaked(frame["body"].tolist())]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words_found", "item_words"])

    asked = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("key"), F.col(text).alias("body"))
    asked = spread(asked)
    out: DataFrame | None = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        prepared = spark.sparkContext.broadcast(Items.prepare([(r[0], r[1]) for r in rows]))
        part = asked.mapInPandas(lambda b, prepared=prepared: scan(b, prepared), "doc_id bigint, item_id bigint, words_found int, item_words int")
        out = part if out is None else out.unionByName(part)
    return out
