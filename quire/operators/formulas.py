"""Formulas of two engines judged by the glyphs that a document brings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import formulas

ATOMS = "array<struct<text:string,script:string,styles:array<string>,role:string,accents:array<string>>>"


def assessed(rows: DataFrame, key: list[str], engines: list[str], glyphs: str = "glyphs") -> DataFrame:
    """(key, engine, text, status, score, changes, faults): for each row the formula that its glyphs prove, or else the first engine's.

    `engines`: columns of candidates, the first of which is repaired and stands where nothing is proved;
    null candidates are none, and of the first an empty formula; null glyphs are none.
    """
    own = rows.select(*key, *[F.col(e).cast("string").alias(f"__{e}") for e in engines], F.coalesce(F.col(glyphs), F.array().cast(ATOMS)).cast(ATOMS).alias("__glyphs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for *texts, held in zip(*(frame[f"__{e}"] for e in engines), frame["__glyphs"], strict=True):
                atoms = [{**g, "text": g["text"] or "", "styles": list(g["styles"]) if g["styles"] is not None else [], "accents": list(g["accents"]) if g["accents"] is not None else []} for g in held]
                told.append(formulas.assess([(e, t if isinstance(t, str) else None) for e, t in zip(engines, texts, strict=True)], atoms))
            out = pd.DataFrame(told, columns=["engine", "text", "status", "score", "changes", "faults"])
            yield pd.concat([frame[key].reset_index(drop=True), out], axis=1)

    keys = ", ".join(f"`{k}` {t}" for k, t in own.select(*key).dtypes)
    return own.mapInPandas(run, f"{keys}, engine string, text string, status string, score int, changes int, faults array<string>")
