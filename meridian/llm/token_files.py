"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are ranked by their count over the whole corpus, so that common ones take one byte. A file holds blocks of
documents in ascending order; a block has its documents' ids and counts, then all control fields (the width of
each value less one, packed into bytes), then all value bytes. Decoding looks each control byte up in a table
that gives the widths and offsets of its values, and needs no loop over values.

Documents are tokenized once and dealt by ranges of doc_id, a doc_id of many rows by ranges of their texts' hashes.
The sorted token table in the shared folder is counted, then written as files by a map over its partitions.
"""

from __future__ import annotations

import struct
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import drop, filesystem, shared_path, slices, texts, written
from meridian.llm.tokens import encoder

MAGIC = b"MTOK1\0"
#: Tokens in a block at least, but for the last; tokens in a file likewise.
BLOCK_TOKENS = 1 << 16
FILE_TOKENS = 1 << 24
#: The optimizer's estimate of the documents that is aimed at in a range; ranges at most, whose bounds tasks hold.
RANGE_BYTES, MAX_RANGES = 64 << 20, 20_000

_HEAD = struct.Struct("<IQQB")


@cache
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each control byte: the widths of its values, their offsets, and all their bytes."""
    per = 8 // bits
    fields = (np.arange(256)[:, None] >> (np.arange(per) * bits)) & ((1 << bits) - 1)
    widths = fields + 1
    ends = widths.cumsum(axis=1)
    return widths.astype(np.int64), (ends - widths).astype(np.int64), ends[:, -1].astype(np.int64)


def control_bits(vocab: int) -> int:
    """One bit a value where two bytes hold every rank, else two."""
    return 1 if vocab <= 1 << 16 else 2


def encode_values(values: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and value bytes. Values fill up the last control byte with zeros."""
    per, most = 8 // bits, 1 << bits
    pad = -len(values) % per
    v = np.concatenate([values.astype("<u4"), np.zeros(pad, "<u4")])
    width = np.ones(len(v), np.int64)
    for k in range(1, most):
        width += v >= np.uint32(1 << (8 * k))
    control = ((width - 1).reshape(-1, per) << (np.arange(per) * bits)).sum(axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most) < width[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int, bits: int) -> np.ndarray:
    """The inverse, by table lookup of whole control bytes."""
    widths, offsets, totals = _tables(bits)
    c = np.frombuffer(control, np.uint8)
    starts = np.concatenate([[0], totals[c].cumsum()[:-1]]) if len(c) else np.zeros(0, np.int64)
    at = (starts[:, None] + offsets[c]).ravel()[:count]
    wide = widths[c].ravel()[:count]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 1 << bits):
        out |= np.where(wide > k, raw[at + k].astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    return out


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray], rank: np.ndarray, bits: int) -> bytes:
    values = rank[np.concatenate(ids)] if ids else np.zeros(0, np.uint32)
    control, data = encode_values(values, bits)
    null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    counts = np.array([len(x) for x in ids], "<u4").tobytes()
    return b"".join([_HEAD.pack(len(doc_ids), len(values), len(data), bits), null, keys, counts, control, data])


def decode_blocks(blob: memoryview, ids_of: np.ndarray):
    """(doc_id, ids) of each document of a file, in order."""
    if bytes(blob[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)

    def take(n: int) -> memoryview:
        nonlocal at
        if at + n > len(blob):
            raise ValueError("the token file is cut short")
        at += n
        return blob[at - n : at]

    while at < len(blob):
        n_docs, n_values, n_data, bits = _HEAD.unpack(take(_HEAD.size))
        null = np.unpackbits(np.frombuffer(take(-(-n_docs // 8)), np.uint8))[:n_docs]
        keys = np.frombuffer(take(8 * n_docs), "<i8")
        counts = np.frombuffer(take(4 * n_docs), "<u4")
        values = decode_values(take(-(-n_values * bits // 8)), take(n_data), n_values, bits)
        ids = ids_of[values]
        ends = counts.cumsum(dtype=np.int64)
        for d, is_null, a, b in zip(keys.tolist(), null.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            yield (None if is_null else d), ids[a:b]


def _bytes(docs: DataFrame) -> int:
    """Roughly the texts' size: the optimizer's estimate, or a sum over the texts where it has none."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 55 else docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0


def range_of(keys: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each row: its key's among sorted cuts. A key that is several cuts has as many ranges more, which
    its rows share by hash, in the order of the hashes; ranges ascend by (key, hash)."""
    low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    share = (hashes >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (low + np.where(high - low > 1, np.minimum((share * (high - low + 1)).astype(np.int64), high - low), 0)).astype(np.int32)


def tokenized(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """documents(doc_id, text) as a written table (part, doc_id, ids), dealt by ranges of doc_id and sorted in each."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    size = _bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-size // RANGE_BYTES)))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("c")).first()["c"]
    bounds = np.sort(np.array(cuts or [], np.int64))

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            keys, rows = b.column(0), texts(b.column(1))
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in rows], np.uint64)
            part = range_of(keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), hashes, bounds)
            ids = [enc.encode(t) + end for t in rows]
            yield pa.record_batch([pa.array(part), keys, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    dealt = docs.mapInArrow(run, "part int, doc_id long, ids binary").repartitionById(n, F.col("part"))
    return written(dealt.sortWithinPartitions("part", "doc_id", "ids"), "tokens")


def count_ids(tokens: DataFrame, dtype: str, vocab: int) -> np.ndarray:
    """How often each id occurs in the whole table; one number per id of the vocabulary reaches the driver."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for x in slices([b], 256):
                total += np.bincount(np.frombuffer(b"".join(x.column(0).to_pylist()), dtype), minlength=vocab)
        seen = total.nonzero()[0]
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(vocab, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> tuple[DataFrame, np.ndarray]:
    """Tokenizes documents(doc_id, text), appends end_id to each, and writes token files in ascending doc_id order.

    Gives the manifest (part, seq, path, n_docs, n_tokens), a row for each file, and the ids by rank. Null text
    is empty; null doc_ids come first; rows with equal doc_id follow in the order of their ids' bytes, and where a
    doc_id has more rows than a range, by ranges of their texts' hashes first. An empty table gives no files; a very long text may exceed a block and a file. Other columns are ignored. A task that runs
    again writes the same files over the first ones, each put in place by a rename.
    """
    spark = documents.sparkSession
    enc = encoder(tokenizer)
    dtype, vocab = enc.dtype.str, enc.vocab
    folder = folder or shared_path(spark, "token-files")
    tokens = tokenized(documents, tokenizer, end_id)
    counts = count_ids(tokens, dtype, vocab)
    ids_of = np.lexsort((np.arange(vocab), -counts)).astype(np.uint32)
    rank = np.empty(vocab, np.uint32)
    rank[ids_of] = np.arange(vocab, dtype=np.uint32)
    bits = control_bits(vocab)

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        sink, part, seq, docs, total = None, -1, 0, 0, 0
        name = tmp = ""
        keys, ids, held, done = [], [], 0, []

        def flush():
            nonlocal keys, ids, held
            if keys:
                sink.write(encode_block(keys, ids, rank, bits))
                keys, ids, held = [], [], 0

        def close():
            nonlocal sink, docs, total
            if sink is not None:
                flush()
                sink.close()
                fs.move(tmp, name)
                done.append((part, seq, name, docs, total))
            sink, docs, total = None, 0, 0

        for b in slices(batches):
            for p, d, raw, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part or total >= file_tokens:
                    close()
                    part, seq = p, at
                if sink is None:
                    name = f"{base}/ids-{part:07d}-{seq:012d}.tok"
                    tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(tmp)
                    sink.write(MAGIC)
                x = np.frombuffer(raw, dtype)
                keys.append(d)
                ids.append(x)
                held, docs, total = held + len(x), docs + 1, total + len(x)
                if held >= BLOCK_TOKENS:
                    flush()
        close()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens"])

    # A range is one file of the table, in order; a row's place there names the token file that it starts.
    placed = tokens.select("part", "doc_id", "ids", F.col("_metadata.row_index").alias("at"))
    manifest = written(placed.mapInArrow(run, "part int, seq long, path string, n_docs long, n_tokens long"), "manifest")
    drop(tokens)
    scheme = folder.split("://", 1)[0]
    return manifest.withColumn("path", F.concat(F.lit(f"{scheme}://"), "path")), ids_of


def read_files(manifest: DataFrame, ids_of: np.ndarray) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids) read back from a manifest's files; start counts all ids before.

    Null and repeated doc_ids come as they were written; an empty manifest gives no rows.
    """
    spark = manifest.sparkSession
    # Ranges are few and counted one after the other; the files of a range follow from its own.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    files = manifest.withColumn("inside", inside).join(F.broadcast(ranges), "part").withColumn("base", F.col("first") + F.col("inside"))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    blob = f.read_buffer()
                rows: list[tuple] = []
                for d, ids in decode_blocks(memoryview(blob), ids_of):
                    rows.append((d, base, len(ids), ids.astype("<u4").tobytes()))
                    base += len(ids)
                    if len(rows) == 512:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return files.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
