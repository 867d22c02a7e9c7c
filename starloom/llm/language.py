"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._shared import materialize, small, text_slices
from starloom.llm._words import mix

GRAM = 4
#: Of texts too long for the usual sample: how much of one is learned from, and until how much a language has, in times ``sample_chars``.
LONG, FULL = 8, 32
#: Bytes of an n-gram: A-Z in lower case, other ASCII but letters as a space; bytes beyond ASCII stay.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = re.compile("[A-Za-z]")
_BLANK = np.uint32(0x20202020)


@dataclass(frozen=True)
class LanguageFilters:
    """``masks``: for each slot one bit a language, 64 languages to a column. ``false``: each language's false-positive rate."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of each text set between spaces, and the first of each text; blank ones are left out."""
    raw = _FOLD[np.frombuffer(b"   ".join([b"", *texts, b""]), np.uint8)].astype(np.uint32)
    at = np.cumsum([2, *[len(x) + 3 for x in texts]])
    h = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    inside = h != _BLANK
    inside[:2] = False
    for back in (1, 2, 3):
        inside[at[1:-1] - back] = False
    inside[at[-1] - 3 :] = False
    places = np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(inside))]
    return h[inside], places


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h.astype(np.uint64) + np.uint64(1))
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64), (x >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, n of rows (lang, text), counted on the executors; a language without n-grams has gram -1."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                h, n = np.unique(grams([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
                values = [pa.array([lang] * (len(h) + 1)), pa.array(np.append(h.astype(np.int64), -1)), pa.array(np.append(n, 0))]
                yield pa.RecordBatch.from_arrays(values, schema=schema)

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(sample: DataFrame, bits: int = 20, least: int = 2, share: float = 0.2) -> LanguageFilters:
    """Filters of (lang, text) rows: a language holds an n-gram that it has at least ``least`` times and
    at ``share`` of the rate of the language richest in it. Only held n-grams reach the driver: some ten
    bytes for each of those of the bounded sample."""
    counts = materialize(gram_counts(sample))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.where("gram >= 0").join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    held = rated.join(best, "gram").where((F.col("n") >= least) & (F.col("rate") >= share * F.col("best"))).select("lang", "gram").toArrow()
    languages = tuple(sorted(r["lang"] for r in totals.select("lang").collect()))
    langs, every = np.array(held.column("lang").to_pylist(), object), held.column("gram").to_numpy().astype(np.uint32)
    return filters_of(languages, [every[langs == x] for x in languages], bits)


def filters_of(languages: tuple[str, ...], held: list[np.ndarray], bits: int) -> LanguageFilters:
    """The bit-sliced filters of the n-grams that each language holds."""
    masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    false = np.zeros(len(languages))
    for i, h in enumerate(held):
        bit, column = np.uint64(1 << (i % 64)), i // 64
        for slots in _slots(h, bits):
            masks[slots, column] |= bit
        false[i] = np.mean((masks[:, column] & bit) > 0) ** 2
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return LanguageFilters(languages, masks, false)


def _predict(filters: LanguageFilters):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            langs, scores = _rates(filters, [x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def _rates(filters: LanguageFilters, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    bits = int(np.log2(len(filters.masks)))
    h, at = grams([x.encode() for x in texts])
    n = np.diff(at)
    first, second = _slots(h, bits)
    hits = filters.masks[first] & filters.masks[second]
    full = np.flatnonzero(n > 0)
    rates = np.zeros((len(filters.languages), len(texts)))
    for i in range(len(filters.languages)):
        if len(full):
            own = (hits[:, i // 64] >> hits.dtype.type(i % 64)) & hits.dtype.type(1)
            rates[i, full] = np.add.reduceat(own, at[full], dtype=np.int64) / n[full]
    rates = np.clip((rates - filters.false[:, None]) / (1 - np.minimum(filters.false[:, None], 0.999)), 0, 1)
    best = rates.argmax(axis=0) if len(filters.languages) else np.zeros(len(texts), int)
    named = [bool(filters.languages) and bool(_LETTER.search(x) or any(map(str.isalpha, x))) for x in texts]
    langs = [filters.languages[b] if ok else "und" for b, ok in zip(best, named, strict=True)]
    return langs, [float(rates[b, i]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, named, strict=True))]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, chars: int) -> DataFrame:
    """lang, text: at most ``rows`` labelled texts a language, chosen by a hash of the id, so that every labelled language is learned.

    Texts of at most ``chars`` characters come first. Where a language has fewer than ``rows`` of
    them, longer ones follow, each by at most its first LONG * ``chars`` characters, until the language
    has FULL * ``chars``. Counts of all labelled rows set the sampling rates, so only about twice the
    wanted rows are ranked.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold != 2)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h"))
    known = known.withColumn("long", F.length("text") > chars)
    total = materialize(known.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n_short"), F.count_if("long").alias("n_long")))
    place = F.pmod("h", F.lit(1 << 20))
    chosen = F.when(~F.col("long"), place * F.col("n_short") < F.lit(float(rows * 2 * (1 << 20)))).otherwise((F.col("n_short") < rows) & (place * F.col("n_long") < F.lit(float(FULL * 2 * (1 << 20)))))
    near = known.join(small(total, 64, total.count()), "lang").where(chosen).withColumn("text", F.when(F.col("long"), F.substring("text", 1, LONG * chars)).otherwise(F.col("text")))
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = near.withColumns({"rank": F.row_number().over(order), "before": before}).where((F.col("rank") <= rows) & (~F.col("long") | (F.col("before") < FULL * chars)))
    return ranked.select("lang", "text")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 500, sample_chars: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``, from its whole text.

    Fits on labelled rows outside the held-out quarter (crc32 of the id's text mod 4 is 2): at most
    ``sample_rows`` texts for each language, those of at most ``sample_chars`` characters first and the
    beginnings of longer ones where these are too few (see training_sample()). Bit-sliced Bloom
    filters give, by one lookup, the languages that hold an n-gram; each language's share of a text's
    n-grams, corrected for its false positives, is its rate. The highest rate names the language (ties:
    the first by code point) and is the score.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if no
    labelled row exists. Very long texts are read whole. A null id is not held out and is not learned from. Equal
    rows get equal answers; other columns are not read, whatever their names; an empty table gives no rows.
    """
    filters = fit(training_sample(docs, id_col, text_col, lang_col, sample_rows, sample_chars))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(filters), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.25, sample_rows: int = 500, sample_chars: int = 1 << 16) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has a score below ``least``; whole rows, all columns.

    Where no labelled row exists nothing can be learned, and all rows with a letter would be ``und``:
    they go. Nulls, very long texts and repeated rows as in identify_languages(); an empty table stays empty.
    """
    filters = fit(training_sample(docs, id_col, text_col, lang_col, sample_rows, sample_chars))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for part in text_slices(iter([named]), f"c{place}", 2 << 20):
                langs, scores = _rates(filters, [x or "" for x in part.column(place).to_pylist()])
                kept = part.filter(pa.array([lang != "und" and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
