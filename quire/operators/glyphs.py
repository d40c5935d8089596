"""Glyphs that a document brings beside its recognised text: styles and their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import alignment
from quire.functions import text as T

GLYPHS = "array<struct<text:string,styles:array<string>>>"
_SPANS = "matched int, target_chars int, source_chars int, status string, spans array<struct<start:int,end:int,styles:array<string>>>"
_FOUND = pa.schema([("matched", pa.int32()), ("target_chars", pa.int32()), ("source_chars", pa.int32()), ("status", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("styles", pa.list_(pa.string()))])))])
#: Rows whose characters lie in arrays at once.
_ROWS = 500


def styled(texts: DataFrame, key: list[str], text: str = "text", glyphs: str = "glyphs") -> DataFrame:
    """(key, matched, target_chars, source_chars, status, spans) of texts beside their glyphs, in reading order.

    A null text has no characters, null glyphs are none; each row is aligned by itself, so nothing is shuffled.
    """
    own = texts.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__text"), F.coalesce(F.col(glyphs), F.array().cast(GLYPHS)).cast(GLYPHS).alias("__glyphs"))
    keys = ", ".join(f"`{k}` {t}" for k, t in own.select(*key).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                found = pa.Table.from_pylist(_found(batch["__text"], batch["__glyphs"]), schema=_FOUND)
                told = [found[n].combine_chunks() for n in _FOUND.names]
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in key), *told], names=[*key, *_FOUND.names])

    return own.mapInArrow(run, f"{keys}, {_SPANS}")


def _found(texts: pa.Array, glyphs: pa.Array) -> list[dict]:
    """`alignment.style_spans` of each row."""
    letters, lists = glyphs.flatten().flatten()
    letters = pc.fill_null(letters, "")
    counts = pc.list_value_length(glyphs).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    sources = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), letters), "").to_pylist()
    coded = pc.dictionary_encode(lists.flatten())
    names = coded.dictionary.to_pylist()
    many = np.int64 if len(names) <= 62 else object
    styles, sizes = np.zeros(len(letters), dtype=many), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    np.bitwise_or.at(styles, np.repeat(np.arange(len(letters)), sizes), np.array([1 << i for i in range(len(names))], dtype=many)[coded.indices.to_numpy(zero_copy_only=False)])
    return alignment.style_rows(texts.to_pylist(), sources, counts.tolist(), pc.utf8_length(letters).to_numpy(zero_copy_only=False), styles, names)


def glyph_runs(text: Column, lost: Column | None = None) -> Column:
    """Glyphs of a text, a run for each word: those of words that begin with a capital are bold, of numbers italic; ligatures are one character. `lost`: array of word places that the source lacks."""

    def word(w: Column) -> Column:
        bold = F.when(w.rlike(r"^\p{Lu}"), F.array(F.lit("bold"))).otherwise(F.array().cast("array<string>"))
        style = F.when(w.rlike(r"^\p{N}"), F.array(F.lit("italic"))).otherwise(bold)
        return F.struct(F.concat(w, F.lit(" ")).alias("text"), style.alias("styles"))

    words = F.split(F.replace(F.replace(text, F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ")), F.lit(" "))
    # Once for all words: within the filter it would be made again for each of them.
    kept = words if lost is None else T.let(lost, lambda gone: F.filter(words, lambda _, i: ~F.array_contains(gone, i)))
    return F.transform(kept, word).cast(GLYPHS)
