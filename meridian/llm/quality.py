"""Quality rules: repetition within a text by suffix array.

Words are the symbols. Suffixes of many texts are sorted at once by prefix doubling, and the longest common prefixes
of neighbours follow from the ranks of each doubling. The intervals of those prefixes are the repeated strings; one
whose places don't all follow the same word is a maximal repeat. The spans of maximal repeats are the places of the
deepest intervals, united; a text fails where those of long repeats cover too much of it or where one of them is too
long. Texts are judged in batches of bounded size where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm.common import release, slices, texts

#: Words of a repeat at least.
REPEAT_WORDS = 5
#: Words in a text at least, and the percentage of words in repeats at most: the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The method's own limits: words of the longest repeat, and the percentage of words in repeats of LONG_WORDS or more.
LONGEST_REPEAT, LONG_WORDS, COVERED = 100, 15, 10
#: Words whose suffixes are sorted together; a longer text is a batch by itself.
BATCH_WORDS = 200_000

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_long_words long, n_maximal long, longest_repeat long, repeat_spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int64()] * 9 + [_SPANS, pa.bool_(), pa.bool_()]

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of symbols, and the ranks after each doubling. ends[p] is where the text of place p ends;
    symbols of different texts must differ."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order[1:]] != symbols[order[:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    ranks = [rank.copy()]
    h = 1
    lone = first & np.append(first[1:], True)
    active = (~lone).nonzero()[0]
    while len(active):
        places = order[active]
        after = places + h
        second = np.where(after < ends[places], rank[np.minimum(after, n - 1)] + 1, 0)
        group = starts[active]
        by = np.argsort(group * np.int64(n + 2) + second, kind="stable")
        order[active] = places = places[by]
        second, group = second[by], group[by]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        at = np.maximum.accumulate(np.where(new, active, 0))
        starts[active] = at
        rank[places] = at
        ranks.append(rank.copy())
        lone = new & np.append(new[1:], True)
        active = active[~lone]
        h *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the words that its suffix shares with the one before; 0 at both ends."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    pair = (ranks[0][order[1:]] == ranks[0][order[:-1]]).nonzero()[0]
    a, b = order[pair].copy(), order[pair + 1].copy()
    size = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r, h = ranks[level], 1 << level
        inside = (np.maximum(a, b) < n) & (a < ends[np.minimum(a, n - 1)]) & (b < ends[np.minimum(b, n - 1)])
        same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        a, b, size = a + h * same, b + h * same, size + h * same
        a, b = np.minimum(a, n), np.minimum(b, n)
    lcp[pair + 1] = size
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(words, first, last) of all intervals of the suffix array whose suffixes share `least` words or more, and no
    neighbour of which shares as many."""
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    before = -1
    at = (lcp >= least).nonzero()[0]
    for i, words in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if i != before + 1:
            out += [(d, lo, before) for d, lo in reversed(open_)]
            open_.clear()
        first = i - 1
        while open_ and open_[-1][0] > words:
            d, first = open_.pop()
            out.append((d, first, i - 1))
        if not open_ or open_[-1][0] < words:
            open_.append((words, first))
        before = i
    return out + [(d, lo, before) for d, lo in reversed(open_)]


def maximal(intervals: list[tuple[int, int, int]], order: np.ndarray, symbols: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
    """The intervals whose places don't all follow the same word; begins[p] is where the text of place p begins."""
    if not intervals:
        return []
    left = np.where(order > begins[order], symbols[order - 1], -1 - order)
    changes = np.concatenate([[0], (left[1:] != left[:-1]).cumsum()])
    _, first, last = np.array(intervals).T
    return [x for x, k in zip(intervals, changes[last] > changes[first], strict=True) if k]


def _covered(m: np.ndarray, least: int) -> np.ndarray:
    """Whether each place lies in a repeat of `least` words or more; m is the longest that starts at a place."""
    long = (m >= least).nonzero()[0]
    cover = np.zeros(len(m) + 1, np.int64)
    np.add.at(cover, long, 1)
    np.add.at(cover, long + m[long], -1)
    return cover[:-1].cumsum() > 0


def repeats(words_of: list[list[bytes]], least: int = REPEAT_WORDS, long: int = LONG_WORDS) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """For each text: its words in repeats of `least` words or more and of `long` or more, how many maximal repeats of
    `least` it has, the longest, and the united spans of those of `least`."""
    numbers, flat = _Numbers(), []
    for words in words_of:
        flat.extend(map(numbers.__getitem__, words))
    sizes = np.array([len(w) for w in words_of], np.int64)
    n = len(flat)
    if not n:
        return [(0, 0, 0, 0, [])] * len(words_of)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(sizes.cumsum(), sizes)
    begins = sizes.cumsum() - sizes
    symbols = np.array(flat, np.int64) + doc * np.int64(len(numbers))
    order, ranks = suffix_order(symbols, ends)
    lcp = common_prefixes(order, ranks, ends)
    found = maximal(lcp_intervals(lcp, least), order, symbols, begins[doc])
    n_maximal, longest = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if found:
        size, first, _ = np.array(found).T
        of = doc[order[first]]
        np.add.at(n_maximal, of, 1)
        np.maximum.at(longest, of, size)
    # A suffix lies in nested intervals, the deepest of which ends furthest; what isn't maximal lies in one that is.
    m = np.zeros(n, np.int64)
    m[order] = np.maximum(lcp[:-1], lcp[1:])
    covered = _covered(m, least)
    n_covered, n_long = (np.bincount(doc, weights=c, minlength=len(sizes)).astype(np.int64) for c in (covered, _covered(m, long)))
    inner = covered.copy()
    inner[1:] &= covered[:-1] & (doc[1:] == doc[:-1])
    inner[:1] = False
    opens = (covered & ~inner).nonzero()[0]
    last = covered.copy()
    last[:-1] &= ~(covered[1:] & (doc[1:] == doc[:-1]))
    closes = last.nonzero()[0] + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        d = int(doc[a])
        spans[d].append((a - int(begins[d]), b - int(begins[d])))
    return list(zip(n_covered.tolist(), n_long.tolist(), n_maximal.tolist(), longest.tolist(), spans, strict=True))


def _failed(n: int, n_rep: int) -> bool:
    return n < LEAST_WORDS or 100 * n_rep > MOST_REPEATED * n


def _batches(batches: Iterable[pa.RecordBatch]):
    held, n = [], 0
    for b in slices(batches):
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            data = text.encode()
            words = data.split()
            lines = [x for x in data.split(b"\n") if x.strip()]
            held.append((doc, len(text), data, words, len(lines) - len(set(lines))))
            n += len(words)
            if n >= BATCH_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


def judge(documents: DataFrame, longest: int = LONGEST_REPEAT, covered: int = COVERED) -> DataFrame:
    """The figures and verdicts of documents(doc_id, text), a row for each row; see SCHEMA.

    Words are maximal runs of what is not ASCII white space; spans count words, end exclusive. Null and empty
    texts have no words and fail. Repeated rows are judged each; a text beyond BATCH_WORDS is a batch by itself; other
    columns are ignored.
    """

    def run(batches):
        release()
        for held in _batches(batches):
            rows = []
            for (doc, chars, data, words, dup), (n_rep, n_long, n_max, most, spans) in zip(held, repeats([h[3] for h in held]), strict=True):
                n = len(words)
                white = len(data) - len(data.translate(None, _WHITE))
                failed = _failed(n, n_rep)
                kept = not failed and most <= longest and 100 * n_long <= covered * n
                rows.append((doc, n, chars - white, len(data) - len(data.translate(None, SYMBOLS)), dup, n_rep, n_long, n_max, most, [{"start": a, "end": b} for a, b in spans], failed, kept))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def kept_documents(documents: DataFrame) -> DataFrame:
    """documents without the rows that fail, columns as they are; judged row by row, so nothing is joined.

    Null and empty texts fail and go; equal rows stay or go together; an empty table stays empty.
    """
    schema, cols = documents.schema, documents.columns
    at = cols.index("text")

    def run(batches):
        release()
        for b in batches:
            verdicts: list[bool] = []
            numbered = pa.record_batch([pa.array(np.arange(b.num_rows)), b.column(at)], names=["doc_id", "text"])
            for held in _batches([numbered]):
                for (_, _, _, words, _), (n_rep, n_long, _, most, _) in zip(held, repeats([h[3] for h in held]), strict=True):
                    n = len(words)
                    verdicts.append(not _failed(n, n_rep) and most <= LONGEST_REPEAT and 100 * n_long <= COVERED * n)
            yield b.filter(pa.array(verdicts, pa.bool_()))

    return documents.mapInArrow(run, schema)
