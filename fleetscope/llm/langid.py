"""Language ID (operator 9) by compression: the language whose dictionary packs the text best.

For each language a raw-content zstandard dictionary is cut from a bounded
sample of labelled rows. The whole text, in lower case, is compressed with each
of them; the smallest result names the language, and a text whose best and
second-best results lie too close together is marked as rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, id_crc32, short_batches

#: Bounds of the fit: documents of each language and characters of each document. A dictionary holds all of its sample that
#: fits into DICT_BYTES, which is the sample of texts without many wide characters.
DOCS_PER_LANG, CHARS_PER_DOC, DICT_BYTES = 400, 160, 1 << 16
#: How many times as many rows as needed lie under the bound that the scan keeps.
SPARE = 4
#: Level of the compressor: the least at which it looks for the best match and not the first.
LEVEL = 5
#: A text is rejected where the runner-up is less than this share larger than the winner; how steeply the score falls with the gap.
MARGIN, STEEP = 0.0005, 16.0
#: Bytes of a text compressed at a time.
BLOCK = 1 << 17
UND = "und"


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """One raw-content dictionary for each language of the training rows, the most frequent language first.

    The sample is the ``DOCS_PER_LANG`` rows of each language with the least
    hash; each gives at most ``CHARS_PER_DOC`` characters. Rows whose hash lies
    over a bound are left out in the scan. The bound follows from the language's
    row count such that some ``SPARE`` times as many rows as needed pass, however
    many tasks or rows there are. A language whose rows all lie over its bound,
    which takes rows that repeat, gives the row with its least hash.
    """
    spark, labelled = df.sparkSession, F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    named = df.where(train).where(labelled).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(id_col).alias("id"),
        F.substring(text_col, 1, CHARS_PER_DOC).alias("data"))
    counts = named.groupBy("lang").agg(F.count("*").alias("rows"), F.min("h").alias("least")).collect()  # a row a language
    order = sorted(counts, key=lambda r: (-r["rows"], r["lang"]))
    bounds = [(r["lang"], max(r["least"], min(2**63 - 1, 2**64 * SPARE * DOCS_PER_LANG // r["rows"] - 2**63))) for r in order]
    near = named.join(F.broadcast(few_rows(spark, bounds, "lang string, bound long")), "lang").where("h <= bound")  # a row a language
    first = Window.partitionBy("lang").orderBy("h", "id", "data")
    kept = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= DOCS_PER_LANG)
    found = kept.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "data"))).alias("docs")).collect()
    docs = {r["lang"]: r["docs"] for r in found}
    return {r["lang"]: " ".join(d["data"].lower() for d in docs[r["lang"]]).encode()[:DICT_BYTES] for r in order}


class Packer:
    """A compressor for each language."""

    def __init__(self, dicts: list[tuple[str, bytes]]):
        self.names, self.packers = [n for n, _ in dicts], [self.compressor(c) for _, c in dicts]

    @staticmethod
    def compressor(content: bytes) -> zstd.ZstdCompressor:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=d)

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that the text takes with each language's dictionary."""
        return [sum(len(p.compress(data[i:i + BLOCK])) for i in range(0, len(data), BLOCK)) for p in self.packers]

    def classify(self, text: str, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the winner's share of the likelihoods that the sizes stand for."""
        if not self.names or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        size = self.sizes(text.lower().encode())
        least = min(size)
        gaps = sorted((n - least) / least for n in size)
        score = 1.0 / sum(math.exp(-min(60.0, STEEP * g)) for g in gaps)
        return self.names[size.index(least)], score, len(size) > 1 and gaps[1] < margin


def identify(df: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, rejected) for each row, from its text alone.

    NULL texts and texts without a letter are ``und`` with score 0, and so is
    every text if no language was learned. Equal sizes go to the language with
    more training rows. Ids may be NULL or repeat; other columns are ignored.
    An empty table gives no rows. A long text is compressed whole, a block after another.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(dicts.items()))  # DICT_BYTES a language

    def run(batches):
        packer = Packer(shared.value)
        for batch in batches:
            rows = [packer.classify(t or "", margin) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                ["id", "lang_pred", "score", "rejected"])

    return short_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, dicts: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows that are not rejected, with all their columns: a filter inside the scan, without a join. NULL texts go; an empty table stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(list(dicts.items()))
    at = df.columns.index(text_col)

    def run(batches):
        packer = Packer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not packer.classify(t or "", margin)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return short_batches(df).mapInArrow(run, df.schema)


def training_rows(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Every row but those of fold 0."""
    return F.coalesce(id_crc32(id_col) % folds, F.lit(0)) != 0
