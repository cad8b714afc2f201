"""Language identification by compression.

For each learned language a raw-content zstandard dictionary is made from labelled texts. A text is of the
language whose dictionary compresses it smallest; it is rejected where the runner-up is nearly as small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, documents, few_rows, small_batches
from .compression import Sizer, hashed_slice, make_dictionary

_LETTER = re.compile(r"[^\W\d_]")
_GAPS = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def letters_only(text: str) -> bytes:
    """The text as compressed: lower case, whatever is ASCII and no letter as one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_GAPS).split())


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    dictionaries: list[bytes]
    #: A text is accepted if the runner-up needs at least this share more bytes.
    min_margin: float
    #: Margin at which the score has covered 1 - 1/e of its way from 0.5 to 1.
    scale: float


def fit_languages(docs: DataFrame, learn: Column, rows_a_language: int = 300, slice_chars: int = 220, dictionary_bytes: int = 65536, model_bytes: int = 64 << 20, min_margin: float = 0.002, scale: float = 0.02, seed: int = 11) -> LanguageModel:
    """Dictionaries from a bounded sample of the rows for which ``learn`` holds.

    The bounds are parameters: ``rows_a_language`` documents of each label, and of each a slice of ``slice_chars``
    characters at a hashed place of the whole text; a dictionary has at most ``dictionary_bytes``, all of them together
    ``model_bytes``. Every label of the column gets a dictionary. Rows with null or empty text or label aren't learned
    from. Documents are taken by a hash of the id, so the sample doesn't depend on the partitions, and rows that repeat
    an id count once. Without labelled rows the model has no language and all texts are ``und``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learn.alias("learn")).where("learn and lang <> '' and text <> ''")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").collect()  # a row a label
    if not counts:
        return LanguageModel([], [], min_margin, scale)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    # About twice as many documents as are wanted, so that the wanted number is nearly surely among them.
    bounds = spark.createDataFrame([(r["lang"], int(min(1.0, 2.0 * (rows_a_language + 10) / max(1, r["ids"])) * (1 << 30))) for r in counts], "lang string, bound long")
    taken = rows.join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("lang", place.alias("place"), "doc_id", hashed_slice(F.col("text"), slice_chars, seed).alias("part"))
    per: dict[str, list] = {}
    for r in taken.groupBy("lang", "place", "doc_id").agg(F.min("part").alias("part")).collect():
        per.setdefault(r["lang"], []).append((r["place"], r["doc_id"], r["part"]))
    languages = [r["lang"] for r in counts if r["lang"] in per]  # most frequent first
    size = min(dictionary_bytes, model_bytes // len(languages)) if languages else 0
    return LanguageModel(languages, [make_dictionary([letters_only(t) for _, _, t in sorted(per[k])[:rows_a_language]], size) for k in languages], min_margin, scale)


class LanguageScorer:
    """Predicts one text at a time on an executor."""

    def __init__(self, model: LanguageModel):
        self.model, self.sizer = model, Sizer(model.dictionaries)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is accepted. ``und``, 0, 0, False for a text without a letter."""
        names = self.model.languages
        if not text or not names or not _LETTER.search(text):
            return "und", 0.0, 0.0, False
        if len(names) == 1:
            return names[0], 1.0, 1.0, True
        sizes = np.array(self.sizer.sizes(letters_only(text)), dtype=float)
        order = np.argsort(sizes, kind="stable")
        margin = float((sizes[order[1]] - sizes[order[0]]) / max(1.0, sizes[order[0]]))
        return names[order[0]], 1.0 - 0.5 * float(np.exp(-margin / self.model.scale)), margin, margin >= self.model.min_margin


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin and accepted of every whole text.

    Null and empty texts and texts without a letter are ``und`` with score 0 and not accepted; on a tie the
    language with most labels wins and the text isn't accepted. Repeated rows give repeated rows. Only
    doc_id and text are read, so other columns may have any name. No shuffle; the model's size is bounded.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = LanguageScorer(held.value)

        def step(batch: pa.RecordBatch) -> dict:
            found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), **{k: [x[i] for x in found] for i, k in enumerate(("lang_pred", "score", "margin", "accepted"))}}

        return step

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, lang_pred string, score double, margin double, accepted boolean", make)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is accepted. Null and empty texts aren't.

    A text column of another type is read as a string, as :func:`identify` does.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = LanguageScorer(held.value)
        for batch in few_rows(batches):
            yield batch.filter(pa.array([scorer.predict(t if t is None or isinstance(t, str) else str(t))[3] for t in batch.column(at).to_pylist()], type=pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned where crc32(doc_id) mod 3 is not 1."""
    docs = documents(spark, sf_dir)
    model = fit_languages(docs, crc_mod("doc_id", 3) != 1)
    return identify(docs, model).withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
