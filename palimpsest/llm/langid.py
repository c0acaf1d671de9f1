"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

learn(labelled) makes one zstandard raw-content dictionary per language from a bounded sample of labelled rows: the whole
texts of the SAMPLE_DOCS rows of smallest hash in each language. identify(docs, model) encodes every whole text with
every dictionary. Before that a text is put in lower case, and runs of what is not a letter become one blank. It goes in
blocks of BLOCK_BYTES, so that long and repetitive texts lean on the dictionary throughout.

Defined cases. Null text, or no letter in it: und, score 0, rejected. Equal sizes: the language first in
order of name, score 0, rejected. Text of several languages: that of most of it, as sizes add up over the blocks. One learned language: score 1. No learned language (empty or unlabelled training
rows): und throughout. Labels that are null are not learned from. Repeated rows: each gets its row. Extra columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, table

#: The bound of the training sample: rows of each language.
SAMPLE_DOCS = 400
BLOCK_BYTES, LEVEL = 1 << 10, 3
#: (second - best) / second below which a text is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters stay (all of non-ASCII text counts as such), others become blanks.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """The words of a text."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split())


def learn(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """labelled: doc_id, text, lang. The dictionaries; docs whole texts of each language reach the driver."""
    rows = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # Four times the wanted number by hash, then exactly the smallest hashes: the window sees a bounded number of rows.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * docs / n)))), F.col("lang"))
    near = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    first = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("i") <= docs)
    texts: dict[str, list[bytes]] = {}
    for r in first.select("lang", "i", "text").orderBy("lang", F.desc("i")).collect():
        texts.setdefault(r["lang"], []).append(plain(r["text"]))
    return {k: b" ".join(v) for k, v in texts.items()}


def sizes_by_language(model: dict[str, bytes]) -> Callable[[str], list[int]]:
    """A function that gives a text's encoded size under each language in turn."""
    coders = []
    for lang in sorted(model):
        dictionary = zstandard.ZstdCompressionDict(model[lang] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in coders]

    return sizes


def _predictor(model: dict[str, bytes], min_margin: float) -> Callable[[list[str]], tuple[list[str], list[float], list[bool]]]:
    langs, sizes = sorted(model), sizes_by_language(model)

    def predict(texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        pred, score = [], []
        for text in texts:
            if not langs or not _LETTER.search(text):
                pred.append(UNKNOWN)
                score.append(0.0)
                continue
            s = sizes(text)
            best = min(s)
            pred.append(langs[s.index(best)])
            rest = sorted(s)[1:2]
            score.append((rest[0] - best) / rest[0] if rest else 1.0)
        return pred, score, [p == UNKNOWN or s < min_margin for p, s in zip(pred, score, strict=True)]

    return predict


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(model, min_margin)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                pred, score, rejected = predict(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, whole, whose language is not rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(model, min_margin)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield part.filter(pa.array([not r for r in predict(texts.to_pylist())[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents that are not held out, predicts all."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
