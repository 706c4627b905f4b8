"""Language by compression: the language whose dictionary compresses a text best.

Each language gets a raw-content zstandard dictionary made from a bounded sample of labelled texts. A text is
compressed in lower case, in blocks, with every dictionary; the smallest total wins, and a narrow margin is a
rejection.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import slices

#: Labelled texts of a language that a fit takes at most, their bytes together, and languages at most.
SAMPLE_TEXTS, DICTIONARY_BYTES, MAX_LANGUAGES = 200, 112 * 1024, 256
#: Level and shortest match of the compressor; short words only count with matches of three bytes.
LEVEL, MIN_MATCH = 6, 3
#: Bytes compressed at a time, so that a long text is judged by the dictionary throughout.
BLOCK = 8192
#: Bytes of a block of a text in a dictionary.
PIECE = 192
#: Share by which the best size must be below the second.
MARGIN = 0.01
UNDETERMINED = "und"

def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _share(h: str) -> Column:
    """A hash as a number from 0 to 1, in its order."""
    return F.col(h) / F.lit(2.0**64) + F.lit(0.5)


def _pieces(share: Column) -> Column:
    """What a text gives to a dictionary within share bytes: itself, or blocks spread over all of it, in order."""
    n = F.ceil(share / F.lit(PIECE)).cast("int")
    long = F.ceil(share / n).cast("int")
    stretch = F.floor(F.length("text") / n).cast("int")
    at = lambda k: k * stretch + F.pmod(F.xxhash64("h", k), F.greatest(stretch - long + 1, F.lit(1))).cast("int") + 1
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("text"), at(k), long))
    return F.when(F.octet_length("text") <= share, F.array("text")).otherwise(spread)


def fit(labelled: DataFrame, texts_each: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from labelled(doc_id, text, lang): of each language, the texts of least hash.

    Each text taken gives an equal share of its language's dictionary: all of it if it fits, else blocks of PIECE bytes
    or so, one at a place by hash in each of equal stretches of the whole text. Those of at most texts_each texts of
    each of MAX_LANGUAGES languages reach the driver; more languages are an error. Rows with null text, lang or doc_id
    teach nothing.
    """
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    share = {r["lang"]: max(1, size // min(texts_each, r["n"])) for r in counts}
    w = Window.partitionBy("lang").orderBy("h")
    # Only hashes that can be among the least go on: a few times texts_each rows a language, however many there are.
    near = F.lit(False)
    for r in counts:
        near = near | ((F.col("lang") == r["lang"]) & (_share("h") <= min(1.0, 4.0 * texts_each / r["n"])))
    picked = [rows.where(near), rows]
    for source in picked:
        best = source.withColumn("r", F.row_number().over(w)).where(F.col("r") <= texts_each).select("lang", "r", _pieces(F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]).alias("pieces")).collect()
        if len(best) == sum(min(texts_each, r["n"]) for r in counts):
            break
    by: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        each = -(-share[r["lang"]] // len(r["pieces"]))
        by.setdefault(r["lang"], []).append(b"\n".join(p.lower().encode()[:each] for p in r["pieces"]))
    return {lang: b"\n".join(parts)[-size:] for lang, parts in by.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as zstd

        self.languages = sorted(dictionaries)
        self.by = []
        for lang in self.languages:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(dictionaries[lang]), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.by.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and the margin by which its size is below the second's, from 0 to 1."""
        if not text or not self.by or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for c, lang in zip(self.by, self.languages, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def predict(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of documents(doc_id, text).

    `und` with score 0 for a text that is null or has no letter, or if no language was learned; rejected says that
    it is `und` or the margin is narrow. Ties go to the first language by name. Other columns are ignored.
    """

    def run(batches):
        model = Classifier(dictionaries)
        for b in slices(batches):
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < margin for s in scores], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
