"""Benchmark decontamination: BM25 over test items with block-max pruning, then verified overlap.

The test items are the index and every passage of every training document is a query. An item's impacts are
divided by its score against itself, so that one threshold serves items of any length. Passages overlap by half
and are at least twice as long as the items they are held against, so an item that a document contains lies
whole in some passage.

The index has a list for each term: its items by block, with the impact on each item and the largest in each block.
As in block-max WAND, a passage is passed over when the largest impacts of its terms cannot reach the threshold. Its
terms of least impact, which together come to SPARE of the threshold at most, are left out of the search for blocks:
a block is passed over when the block's largest impacts of the other terms, with all that is left out, cannot reach
the threshold. The items of the blocks that remain are scored exactly, and all that reach it are retrieved. Many
passages go through these steps together. A retrieved item counts when its question and its answer both overlap.

The index is a checked size: items come to the driver in parts of PART_BYTES or so, one after the other, and each
part's index is a file in the shared folder that tasks read. A larger benchmark means more passes over the documents,
with the same result: item count, mean length and document frequencies are counted once over the whole benchmark, and
all texts of an item_id lie in one part.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import drop, filesystem, kept, release, shared_path, slices, texts, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be retrieved.
THRESHOLD = 0.5
#: Share of the word pairs of question and of answer that must be in the passage.
QUESTION, ANSWER = 0.5, 0.5
#: Words of an answer at least; items of a block; bytes of items in a pass.
ANSWER_WORDS, BLOCK_ITEMS, PART_BYTES = 8, 4, 16 << 20
#: Share of the threshold that the terms left out of the search for blocks come to at most.
SPARE = 0.25
#: Sums of passages and blocks, and postings, that are handled together.
CELLS, POSTINGS = 1 << 21, 1 << 21
#: Words of the shortest passages' halves; documents' words handled together.
HALF, BATCH_WORDS = 64, 100_000

#: Room for the rounding of single-precision impacts.
_SLACK = 1e-5
_MARKS = bytes(32 if not chr(i).isalnum() and i < 128 else i for i in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long"


def terms(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks count as blanks."""
    return text.lower().encode().translate(_MARKS).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's answer is its last sentence, ANSWER_WORDS words at least but never more than half; the rest asks."""
    words = terms(text)
    last = len(terms(_SENTENCE.split(text.strip())[-1]))
    n = min(max(last, ANSWER_WORDS), len(words) // 2)
    return words[: len(words) - n], words[len(words) - n :]


@dataclass
class Lists:
    """Items of one length class as lists by term. Item j lies in block j // BLOCK_ITEMS; the blocks in which a term has
    items are entries `starts[term]` to `starts[term + 1]`, and entry e has the postings `first[e]` to `first[e + 1]`."""

    half: int
    items: np.ndarray
    term_max: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    first: np.ndarray
    postings: np.ndarray
    impacts: np.ndarray

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK_ITEMS)


@dataclass
class Index:
    """The terms' numbers, the items' ids, their pairs of question and answer (codes by item), and lists by length class."""

    vocab: dict[bytes, int]
    item_ids: list
    pairs: tuple[np.ndarray, np.ndarray]
    bounds: tuple[np.ndarray, np.ndarray]
    lists: list[Lists]

    def save(self, path: str) -> None:
        fs, name = filesystem(path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        arrays = {f"{f.name}{k}": getattr(x, f.name) for k, x in enumerate(self.lists) for f in fields(Lists)}
        arrays |= {f"{n}{k}": x[k] for n, x in (("pairs", self.pairs), ("bounds", self.bounds)) for k in range(2)}
        out = io.BytesIO()
        np.savez(out, classes=len(self.lists), vocab=np.frombuffer(b"\n".join(self.vocab), np.uint8), ids=np.array([i or 0 for i in self.item_ids], np.int64), null=np.array([i is None for i in self.item_ids], bool), **arrays)
        with fs.open_output_stream(name, compression=None) as f:
            f.write(out.getbuffer())

    @classmethod
    def load(cls, path: str) -> Index:
        fs, name = filesystem(path)
        with fs.open_input_file(name) as f:
            z = np.load(io.BytesIO(f.read()), allow_pickle=False)
        words = z["vocab"].tobytes().split(b"\n") if len(z["vocab"]) else []
        lists = [Lists(int(z[f"half{k}"]), *[z[f"{f.name}{k}"] for f in fields(Lists)[1:]]) for k in range(int(z["classes"]))]
        ids = [None if n else i for i, n in zip(z["ids"].tolist(), z["null"].tolist(), strict=True)]
        return cls({w: n for n, w in enumerate(words)}, ids, (z["pairs0"], z["pairs1"]), (z["bounds0"], z["bounds1"]), lists)


@dataclass
class Statistics:
    """What BM25 takes from a whole benchmark: its items with a word, their mean length, the items that have a term."""

    items: int
    mean: float
    df: dict[bytes, int]


def statistics(words: list[list[bytes]]) -> Statistics:
    n = sum(1 for w in words if w)
    return Statistics(n, sum(map(len, words)) / max(1, n), Counter(t for w in words for t in set(w)))


def build(items: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
    """An index over items (item_id, text), which are the whole benchmark unless its figures are given. Items without a
    word are left out."""
    rows = [(i, t, terms(t)) for i, t in items]
    whole = whole or statistics([w for _, _, w in rows])
    df, mean = whole.df, whole.mean
    # Items whose common words agree lie in one block, which keeps the blocks' largest impacts low.
    rows = sorted((x for x in rows if x[2]), key=lambda x: (sorted(set(x[2]), key=lambda t: (-df[t], t))[:4], x[0] is None, x[0] or 0))
    vocab = {t: k for k, t in enumerate(sorted({t for _, _, w in rows for t in w}))}
    idf = np.array([math.log(1 + (whole.items - df[t] + 0.5) / (df[t] + 0.5)) for t in vocab])
    ids = [np.array([vocab[t] for t in w], np.int64) for _, _, w in rows]
    asked = [[_codes(np.array([vocab[t] for t in part], np.int64), len(vocab)) for part in question_answer(t)] for _, t, _ in rows]
    pairs = tuple(np.concatenate([np.zeros(0, np.int64), *[a[k] for a in asked]]) for k in range(2))
    bounds = tuple(np.cumsum([0, *[len(a[k]) for a in asked]]) for k in range(2))
    by_half: dict[int, list[int]] = {}
    for n, x in enumerate(ids):
        by_half.setdefault(max(HALF, 1 << (len(x) - 1).bit_length()), []).append(n)
    lists = [_lists(half, some, ids, idf, mean) for half, some in sorted(by_half.items())]
    return Index(vocab, [i for i, _, _ in rows], pairs, bounds, lists)


def _lists(half: int, items: list[int], ids: list[np.ndarray], idf: np.ndarray, mean: float) -> Lists:
    found = []
    for j, n in enumerate(items):
        term, f = np.unique(ids[n], return_counts=True)
        impact = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ids[n]) / mean))
        found.append((term, np.full(len(term), j, np.int32), (impact / impact.sum()).astype(np.float32)))
    term, item, impact = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    block = item // BLOCK_ITEMS
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    first = np.append(new.nonzero()[0], len(term))
    term_max = np.zeros(len(idf), np.float32)
    np.maximum.at(term_max, term, impact)
    starts = np.searchsorted(term[first[:-1]], np.arange(len(idf) + 1))
    return Lists(half, np.array(items, np.int32), term_max, starts, block[first[:-1]], np.maximum.reduceat(impact, first[:-1]), first, item, impact)


def _codes(words: np.ndarray, vocab: int) -> np.ndarray:
    """The distinct pairs of a text's words by their numbers, or its words where there is but one; unknown ones are left out."""
    if len(words) == 1:
        return -1 - words[words >= 0]
    a, b = words[:-1], words[1:]
    known = (a >= 0) & (b >= 0)
    return np.unique(a[known] * vocab + b[known])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of each."""
    ends = size.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _together(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose sizes come to `most` or so."""
    cuts = np.unique(np.searchsorted(size.cumsum(), np.arange(0, int(size.sum()) + most, most), side="left"))
    ends = [*cuts[1:].tolist(), len(size)] if len(cuts) else [len(size)]
    out, at = [], 0
    for e in ends:
        if e > at:
            out.append((at, e))
            at = e
    return out


def retrieve(lists: Lists, ids: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(document, first word of the passage, item, score) of all passages that reach the threshold, of documents of so
    many words each, whose terms' numbers (-1 for others) follow one another."""
    count = np.maximum(-(-sizes // lists.half) - 1, np.minimum(sizes, 1))
    before = np.concatenate([[0], count.cumsum()])
    v, limit = len(lists.term_max), threshold - _SLACK
    known = (ids >= 0).nonzero()[0]
    known = known[lists.term_max[ids[known]] > 0]
    doc = np.repeat(np.arange(len(sizes)), sizes)[known]
    half = (known - (sizes.cumsum() - sizes)[doc]) // lists.half
    term = ids[known]
    later, sooner = half < count[doc], half > 0  # a passage is two halves: each half but the ends is in two
    key = np.unique(np.concatenate([((before[doc] + half) * v + term)[later], ((before[doc] + half - 1) * v + term)[sooner]]))
    passage, term = key // v, key % v
    most = lists.term_max[term].astype(np.float64)
    used = (np.bincount(passage, weights=most, minlength=int(before[-1])) >= limit)[passage]
    passage, term, most = passage[used], term[used], most[used]
    if not len(passage):
        return []
    names, passage = np.unique(passage, return_inverse=True)
    order = np.lexsort((most, passage))
    passage, term, most = passage[order], term[order], most[order]
    starts = np.searchsorted(passage, np.arange(len(names) + 1))
    total = np.concatenate([[0.0], most.cumsum()])
    spare = total[1:] - total[starts[passage]] <= SPARE * threshold
    left_out = np.bincount(passage, weights=most * spare, minlength=len(names))
    # Blocks that can hold an item that reaches the threshold.
    asked_of, asked = passage[~spare], term[~spare]
    size = lists.starts[asked + 1] - lists.starts[asked]
    per = np.bincount(asked_of, weights=size, minlength=len(names)).astype(np.int64)
    at = np.searchsorted(asked_of, np.arange(len(names) + 1))
    found = []
    for lo, hi in _together(np.maximum(per, lists.n_blocks), CELLS):
        some = slice(at[lo], at[hi])
        entry = _ranges(lists.starts[asked[some]], size[some])
        cell = np.repeat(asked_of[some] - lo, size[some]) * lists.n_blocks + lists.blocks[entry]
        sums = np.bincount(cell, weights=lists.block_max[entry], minlength=(hi - lo) * lists.n_blocks).reshape(hi - lo, -1)
        p, b = (sums >= (limit - left_out[lo:hi])[:, None]).nonzero()
        found.append((p + lo, b))
    p, b = (np.concatenate(x) for x in zip(*found, strict=True))
    out: list[tuple[int, int, int, float]] = []
    entries = np.repeat(np.arange(v, dtype=np.int64), np.diff(lists.starts)) * lists.n_blocks + lists.blocks
    terms_of = np.diff(starts)[p]
    for lo, hi in _together(terms_of, POSTINGS):
        # The postings of each passage's terms in each of its blocks.
        n = terms_of[lo:hi]
        want = term[_ranges(starts[p[lo:hi]], n)] * lists.n_blocks + np.repeat(b[lo:hi], n)
        entry = np.minimum(np.searchsorted(entries, want), len(entries) - 1)
        there = entries[entry] == want
        entry, pair = entry[there], np.repeat(np.arange(hi - lo), n)[there]
        size = lists.first[entry + 1] - lists.first[entry]
        posting = _ranges(lists.first[entry], size)
        cell = np.repeat(pair, size) * BLOCK_ITEMS + lists.postings[posting] % BLOCK_ITEMS
        scores = np.bincount(cell, weights=lists.impacts[posting], minlength=(hi - lo) * BLOCK_ITEMS)
        for c in (scores >= limit).nonzero()[0].tolist():
            k, j = lo + c // BLOCK_ITEMS, c % BLOCK_ITEMS
            name = int(names[p[k]])
            d = int(np.searchsorted(before, name, side="right")) - 1
            out.append((d, (name - int(before[d])) * lists.half, int(lists.items[b[k] * BLOCK_ITEMS + j]), float(scores[c])))
    return out


def overlaps(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """The shares of the question's and of the answer's word pairs that a passage has; what has none is covered."""
    have = np.concatenate([_codes(passage, len(index.vocab)), -1 - passage])
    parts = [x[at[item] : at[item + 1]] for x, at in zip(index.pairs, index.bounds, strict=True)]
    return tuple(float(np.isin(x, have).sum()) / len(x) if len(x) else 1.0 for x in parts)


def matches(index: Index, docs: list[list[bytes]], threshold: float, question: float, answer: float) -> list[dict[int, tuple]]:
    """For each document, the verified items with their best passage: (score, question, answer, first word)."""
    found: list[dict] = [{} for _ in docs]
    get = index.vocab.get
    sizes = np.array([len(w) for w in docs], np.int64)
    ids = np.array([get(t, -1) for w in docs for t in w], np.int64)
    begins = sizes.cumsum() - sizes
    for lists in index.lists:
        for d, at, item, score in retrieve(lists, ids, sizes, threshold):
            a = int(begins[d])
            q, s = overlaps(index, item, ids[a + at : a + min(at + 2 * lists.half, int(sizes[d]))])
            if q >= question and s >= answer:
                key, new = index.item_ids[item], (score, q, s, at)
                old = found[d].get(key)
                if old is None or (-new[0], new[3]) < (-old[0], old[3]):
                    found[d][key] = new
    return found


def _dealt(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's rows with a text and the part of each, all texts of an item in one; the number of parts."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-size // PART_BYTES)
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n)))), n


def _part(rows: DataFrame, k: int) -> list[tuple[int, str]]:
    return sorted(((r["item_id"], r["text"]) for r in rows.where(F.col("part") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def parts(benchmark: DataFrame):
    """The benchmark's items in parts that are known to be small."""
    rows, n = _dealt(benchmark)
    for k in range(n):
        yield _part(rows, k)


def _tallies(rows: DataFrame) -> DataFrame:
    """(part, term, items, words): the items of a part that have a term; those with any word where it is null, and their words."""
    schema = "part long, term binary, items long, words long"

    def run(batches):
        release()
        for b in slices(batches):
            items, words = Counter(), Counter()
            for part, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                w = terms(text)
                if w:
                    items.update((part, t) for t in {None, *w})
                    words[part, None] += len(w)
            columns = [[p for p, _ in items], [t for _, t in items], list(items.values()), [words[x] for x in items]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["part", "term", "items", "words"])

    return rows.select("part", "text").mapInArrow(run, schema).groupBy("part", "term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))


def indexes(benchmark: DataFrame):
    """Files of the index of each part of the benchmark, with the figures of the whole for the part's terms."""
    spark = benchmark.sparkSession
    rows, n = _dealt(benchmark)

    def saved(index: Index) -> str:
        path = shared_path(spark, "benchmark-index") + ".npz"
        index.save(path)
        return path

    if n < 2:
        yield from (saved(build(_part(rows, k))) for k in range(n))
        return
    table = written(_tallies(rows), "benchmark-terms")
    total = table.where("term is null").agg(F.sum("items").alias("items"), F.sum("words").alias("words")).first()
    items, words = total["items"] or 0, total["words"] or 0
    whole = table.where("term is not null").groupBy("term").agg(F.sum("items").alias("df"))
    for k in range(n):
        own = table.where(F.col("part") == k).select("term").join(whole, "term")
        yield saved(build(_part(rows, k), Statistics(items, words / max(1, items), {bytes(r["term"]): r["df"] for r in own.collect()})))
    drop(table)


def loaded(path: str) -> Index:
    """One index at a time in a worker process."""
    return kept(("index", path), lambda: Index.load(path))


def _groups(batches, at: int):
    """(batch, rows of it, their words), so many words at a time."""
    for b in slices(batches):
        lo, held, n = 0, [], 0
        for r, t in enumerate(texts(b.column(at))):
            held.append(terms(t))
            n += len(held[-1])
            if n >= BATCH_WORDS:
                yield b.slice(lo, r + 1 - lo), held
                lo, held, n = r + 1, [], 0
        if held:
            yield b.slice(lo), held


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Verified matches of documents(doc_id, text) with benchmark(item_id, text); see SCHEMA. word: where the passage starts.

    A row for each document row and item, with its best passage; of equal scores the first passage. Null and empty
    texts match nothing; items without a word match nothing; BM25 statistics are those of the whole benchmark. A very
    long text is searched whole, in passages as any other. Other columns are ignored. threshold is above 0.
    """
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    for path in indexes(benchmark):

        def run(batches, path=path):
            index = loaded(path)
            for b, held in _groups(batches, 1):
                found = matches(index, held, threshold, question, answer)
                rows = [(doc, item, round(x[0], 6), x[1], x[2], x[3]) for doc, m in zip(b.column(0).to_pylist(), found, strict=True) for item, x in sorted(m.items(), key=lambda kv: (kv[0] is None, kv[0] or 0))]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        out = out.union(documents.select("doc_id", "text").mapInArrow(run, SCHEMA))
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """documents without the rows that match an item, columns as they are; row by row, so nothing is joined.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark leaves all.
    """
    schema, at = documents.schema, documents.columns.index("text")
    for path in indexes(benchmark):

        def run(batches, path=path):
            index = loaded(path)
            for b, held in _groups(batches, at):
                yield b.filter(pa.array([not m for m in matches(index, held, threshold, question, answer)], pa.bool_()))

        documents = documents.mapInArrow(run, schema)
    return documents
