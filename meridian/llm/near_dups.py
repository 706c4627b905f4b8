"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters a document's shingles, the second is read at
positions shifted circularly by 1, 2, ..., one shift for each coordinate. Bands of coordinates are buckets.

Equal sets collapse to one document first. In each bucket all others are verified against its smallest document;
documents that are connected by then need no further comparison, and what remains apart in a bucket is verified
by blocks against blocks inside a task, which gives links and no pairs. Verification is on full shingle sets.
Components come from contraction rounds under random relabelling; every table in between is written to the
shared folder, and nothing that grows with the documents reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meridian.llm.common import drop, kept, mix64, release, slices, texts, written

#: Words of a shingle and the percentage of similarity from which documents are linked.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Coordinates of a band, and the probability at most with which a pair at the threshold shares no band.
ROWS, MISS = 5, 1e-6
#: Tasks over which the rows of one set, or the partners of one document, are dealt at least; rows for which there is
#: another.
SALTS, SALT_ROWS = 32, 1_000_000
#: Documents of a block, and shingles of a block, at most on average.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
_SEEDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COLUMNS = 2048


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that a threshold needs: 24 at 85 %, 35 at 80 %."""
    share = (percent / 100) ** rows
    return 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))


class _Hashes(dict):
    """Word to 64-bit hash, for as many words as fit; long ones, which seldom come again, are not kept."""

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = h
        return h


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles; A-Z lower-cased, words between ASCII white space."""
    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(kept("word hashes", _Hashes).__getitem__, ws)), np.uint64)
    k = min(words, len(ws))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation, shifted by k, over the items."""
    first = mix64(items + _SEEDS[0])
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    shifts = np.arange(1, size + 1, dtype=np.uint64)[:, None]
    for at in range(0, len(first), _COLUMNS):
        np.minimum(out, mix64((first[None, at : at + _COLUMNS] - shifts) ^ _SEEDS[1]).min(axis=1), out=out)
    return out


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band; the band's number is part of it."""
    h = mix64(np.arange(1, n_bands + 1, dtype=np.uint64))
    for j in range(rows):
        h = mix64(h * np.uint64(31) + sig.reshape(n_bands, rows)[:, j])
    return h.view(np.int64)


def sketches(documents: DataFrame, words: int, n_bands: int, rows: int) -> DataFrame:
    """(doc_id, n, fa, fb, bands, row): set size, 128-bit fingerprint of the set, buckets, and a number that deals rows."""

    def run(batches):
        row = 0
        for b in slices(batches):
            out = []
            for t in texts(b.column(1)):
                s = shingles(t, words)
                if len(s):
                    out.append((len(s), *fingerprint(s), bands(signature(s, n_bands * rows), n_bands, rows).tolist()))
                else:
                    out.append((0, 0, 0, []))
            n, fa, fb, bk = zip(*out, strict=True)
            numbers = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(bk, pa.list_(pa.int64())), numbers], names=["doc_id", "n", "fa", "fb", "bands", "row"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fa long, fb long, bands array<long>, row long")


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; zeros for the empty one."""
    if not len(items):
        return 0, 0
    raw = items.tobytes()
    a, b = np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)], np.uint64).view(np.int64)
    return int(a), int(b)


def with_sets(documents: DataFrame, words: int) -> DataFrame:
    """documents with n, fa, fb of their sets in front, in columns of these names and _0, _1, ... for their own."""
    own = documents.toDF(*[f"_{i}" for i in range(len(documents.columns))])
    at, names = documents.columns.index("text"), ["n", "fa", "fb", *own.columns]

    def run(batches):
        for b in slices(batches):
            found = [shingles(t, words) for t in texts(b.column(at))]
            marks = [fingerprint(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in found], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), *b.columns], names=names)

    return own.mapInArrow(run, StructType([*[StructField(n, LongType()) for n in ("n", "fa", "fb")], *own.schema.fields]))


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """(doc, n, items) of documents(doc_id, text, several): a document of several sets has a node for each."""

    def run(batches):
        for b in slices(batches):
            found = [shingles(t, words).view(np.int64) for t in texts(b.column(1))]
            marks = [fingerprint(s) if some else (0, 0) for s, some in zip(found, b.column(2).to_pylist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.record_batch([b.column(0), b.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "several", "n", "fa", "fb", "items"])

    sets = documents.select("doc_id", "text", "several").mapInArrow(run, "doc_id long, several boolean, n long, fa long, fb long, items array<long>")
    return sets.select(_node(F.col("several")), "n", "items")


def _node(several: Column) -> Column:
    """The node of a set: its document, or a hash of both where that has several sets."""
    return F.when(several, F.xxhash64("doc_id", "fa", "fb", "n")).otherwise(F.col("doc_id")).alias("doc")


def _alike(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * inter >= F.lit(percent) * (a + b - inter)


def _star_links(multi: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between the smallest document of each bucket and the others there."""
    pairs = multi.where("doc <> least_doc").select(F.col("least_doc").alias("a"), F.col("doc").alias("b")).distinct()
    salts = max(SALTS, -(-multi.count() // SALT_ROWS))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    left = pairs.select("a", "salt").distinct().join(sets.selectExpr("doc as a", "n as na", "items as ia"), "a")
    right = pairs.join(sets.selectExpr("doc as b", "n as nb", "items as ib"), "b")
    both = right.join(left, ["a", "salt"]).where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    inter = F.size(F.array_intersect("ia", "ib"))
    return both.where(_alike(inter, F.col("na"), F.col("nb"), percent)).select("a", "b")


def block_links(docs: list[int], labels: list[int], own: list[bool], items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect documents with different labels: all pairs if own is all true, else own against others.

    Intersections are products of 0/1 matrices over the shingles that at least two of the documents have.
    """
    sizes = np.array([len(x) for x in items], np.float64)
    rows = np.repeat(np.arange(len(items)), sizes.astype(np.int64))
    values, column, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = np.full(len(values), -1, np.int64)
    shared[count > 1] = np.arange(int((count > 1).sum()))
    column = shared[column]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    mine = np.array(own, bool)
    a_rows = mine.nonzero()[0]
    b_rows = a_rows if mine.all() else (~mine).nonzero()[0]
    inter = np.zeros((len(a_rows), len(b_rows)), np.float64)
    for at in range(0, int((count > 1).sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        m = np.zeros((len(items), _COLUMNS), np.float32)
        m[rows[lo:hi], column[lo:hi] - at] = 1
        inter += m[a_rows] @ m[b_rows].T
    union = sizes[a_rows][:, None] + sizes[b_rows][None, :] - inter
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(100 * inter >= percent * union).nonzero(), strict=True):
        a, b = int(a_rows[i]), int(b_rows[j])
        ra, rb = root(labels[a]), root(labels[b])
        if ra != rb:
            parent[ra] = rb
            out.append((docs[a], docs[b]))
    return out


def _block_links(multi: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between documents of a bucket that are still apart."""
    here = multi.where("doc <> least_doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("label", F.xxhash64("doc")).alias("label"))
    apart = here.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m"), F.sum("n").alias("w")).where("l <> h")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("w") / BLOCK_SHINGLES)).cast("int")
    rows = here.join(apart.select("bucket", blocks.alias("k")), "bucket").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("k")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "label", (F.col("own") == F.least("own", "other")).alias("first"))
    rows = rows.join(sets.select("doc", "items"), "doc").select("bucket", "i", "j", "doc", "label", "first", "items")

    def run(batches):
        release()
        key, held = None, []

        def done():
            docs, labels_, first = ([h[x] for h in held] for x in range(3))
            if len(set(labels_)) > 1 and any(first):
                yield from block_links(docs, labels_, first, [h[3] for h in held], percent)

        for b in slices(batches, 128):
            out = []
            cols = [b.column(c).to_pylist() for c in range(6)]
            items = b.column(6)
            for r in range(b.num_rows):
                k = (cols[0][r], cols[1][r], cols[2][r])
                if k != key:
                    if held:
                        out += done()
                    key, held = k, []
                held.append((cols[3][r], cols[4][r], cols[5][r], items[r].values.to_numpy()))
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])
        if held and (out := list(done())):
            yield pa.record_batch([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links(a, b): equal labels for connected nodes.

    Each round every node goes to the least label among its neighbours and itself, edges inside a label vanish,
    and labels are hashed anew (a bijection of 64-bit integers), so that the number of rounds is logarithmic.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    state = written(nodes.select("node", F.xxhash64("node").alias("label")), "labels")
    edges = written(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")).select(F.col("a").alias("from"), "least"), "moves")
        moved = state.join(to, state["label"] == to["from"], "left").select("node", F.xxhash64(F.coalesce("least", "label")).alias("label"))
        state, old_state = written(moved, "labels"), state
        ends = edges.join(to.selectExpr("from as a", "least as la"), "a").join(to.selectExpr("from as b", "least as lb"), "b").where("la <> lb")
        edges, old_edges = written(ends.select(F.xxhash64("la").alias("a"), F.xxhash64("lb").alias("b")).distinct(), "edges"), edges
        for x in (to, old_state, old_edges):
            drop(x)
    drop(edges)
    return state


def _grouped(documents: DataFrame, words: int, percent: int, rows: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(doc_id, n, fa, fb, component_id) for each row, the written tables that it reads, and the documents of several sets."""
    docs = documents.select("doc_id", "text")
    all_ = written(sketches(docs, words, bands_for(percent, rows), rows), "sketches")
    salts = max(SALTS, -(-all_.count() // SALT_ROWS))
    real = all_.where("n > 0 and doc_id is not null")
    salt = F.pmod("row", F.lit(salts)).alias("salt")
    apart = all_.where("doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{c}{k}") for c in ("fa", "fb", "n") for k, f in enumerate((F.min, F.max))])
    several = written(apart.where("fa0 <> fa1 or fb0 <> fb1 or n0 <> n1").select("doc_id"), "several")
    some = not several.isEmpty()
    flag = F.col("several").isNotNull() if some else F.lit(False)

    def flagged(rows_: DataFrame) -> DataFrame:
        return rows_.join(several.withColumn("several", F.lit(True)), "doc_id", "left") if some else rows_

    parts = real.groupBy("fa", "fb", "n", salt).agg(F.min("doc_id").alias("m"), F.count("*").alias("c"))
    reps = parts.groupBy("fa", "fb", "n").agg(F.min("m").alias("doc_id"), F.sum("c").alias("c"), F.collect_set("salt").alias("salts"))
    reps = written(flagged(reps).select("fa", "fb", "n", "doc_id", "c", "salts", _node(flag)), "sets")
    chosen = real.join(reps.select("fa", "fb", "n", "doc_id", "doc"), ["fa", "fb", "n", "doc_id"])
    placed = chosen.select("doc", "doc_id", "n", F.explode("bands").alias("bucket")).distinct()
    shared = placed.groupBy("bucket").agg(F.min("doc").alias("least_doc"), F.max("doc").alias("h")).where("least_doc <> h").drop("h")
    multi = written(placed.join(shared, "bucket"), "buckets")
    wanted = multi.select("doc_id").distinct()
    sets = written(shingle_sets(flagged(docs.join(wanted, "doc_id", "left_semi")).select("doc_id", "text", flag.alias("several")), words).dropDuplicates(["doc"]), "shingles") if some else written(shingle_sets(docs.join(wanted, "doc_id", "left_semi").withColumn("several", flag), words), "shingles")
    multi_ = multi.drop("doc_id")
    stars = written(_star_links(multi_, sets, percent), "links")
    labels = components(stars)
    more = written(_block_links(multi_, labels, sets, percent), "links")
    if not more.isEmpty():
        labels, old = components(stars.union(more)), labels
        drop(old)
    for x in (multi, sets, stars, more):
        drop(x)
    named = labels.join(reps.select(F.col("doc").alias("node"), "doc_id"), "node") if some else labels.withColumn("doc_id", F.col("node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = labels.join(least, "label").select(F.col("node").alias("doc"), "component_id")
    of_set = reps.join(linked, "doc", "left").where("c > 1 or component_id is not null").select("fa", "fb", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.explode("salts").alias("salt"))
    of_row = all_.select("doc_id", "n", "fa", "fb", salt).join(of_set, ["fa", "fb", "n", "salt"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = of_row.select("doc_id", "n", "fa", "fb", F.when(own, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, [all_, reps, labels], several


def groups(documents: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents(doc_id, text), a row for each row.

    component_id is the smallest doc_id that links lead to. Null and empty texts have no shingles and no links; a
    null doc_id has neither, and a null component_id. Each row is judged by its own text, so rows of one doc_id with
    different texts may lie in different groups, and equal rows lie in one. A very long text is compared whole. Other
    columns are ignored.
    """
    return _grouped(documents, words, percent, rows)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """documents with one document of each group, that of the smallest doc_id; rows without a doc_id all stay.

    Of rows of one doc_id with equal sets of shingles (repeated rows, above all) one stays, the one whose columns hash
    to the least; rows of one doc_id with different sets are documents of their own, and none goes for another's text.
    """
    grouped, tables, several = _grouped(documents, words, percent, ROWS)
    found = written(grouped, "groups")
    for x in tables:
        drop(x)
    some = not several.isEmpty()
    single = found.join(several, "doc_id", "left_anti") if some else found
    gone = single.where("doc_id <> component_id").select("doc_id").distinct()
    again = single.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    names = documents.columns
    own = documents.toDF(*[f"_{i}" for i in range(len(names))])
    id_ = f"_{names.index('doc_id')}"

    def with_(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(ids.withColumnRenamed("doc_id", id_), id_, how).select(*own.columns)

    def one(rows: DataFrame, key: list[str]) -> DataFrame:
        rest = F.struct(*own.columns)
        return rows.groupBy(*key).agg(F.min_by(rest, F.xxhash64(*own.columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in own.columns])

    kept = with_(own, gone, "left_anti")
    if some or not again.isEmpty():
        twice = again.union(several)
        out = with_(kept, twice, "left_anti").unionByName(one(with_(kept, again, "left_semi"), [id_]))
        if some:
            key = [id_, "n", "fa", "fb"]
            first = found.join(several, "doc_id", "left_semi").where("doc_id = component_id").select(F.col("doc_id").alias(id_), "n", "fa", "fb").distinct()
            marked = with_sets(with_(own, several, "left_semi").toDF(*names), words)
            out = out.unionByName(one(marked.join(first, key, "left_semi"), key))
        kept = out
    return kept.toDF(*names)
