"""Fill-in-the-middle transformation of whole texts.

A text is decoded into an array of code points; comparing the classes of neighbouring ones gives the places where its
units (lines, words or characters) begin. Two ranks chosen by a hash of the document's id name the boundaries at which
the array is cut into prefix, middle and suffix, which are put together around markers and encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerloom.llm.texts import release, slices, table

#: Begin prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
PERCENT, SPM_PERCENT = 100, 50
UNITS = ("line", "word", "char")
_WHITE = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
_FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4"))


def boundaries(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """0, the places where the later units begin, and the length; just 0 for no code points.

    A line ends with its line feed, a word with the white space behind it; white space that begins a text is a unit.
    """
    if not len(codes):
        return np.zeros(1, np.int64)
    if unit == "char":
        return np.arange(len(codes) + 1)
    ends = codes == 0x0A if unit == "line" else np.isin(codes, _WHITE)
    starts = ends[:-1] if unit == "line" else ends[:-1] & ~ends[1:]
    return np.concatenate(([0], np.flatnonzero(starts) + 1, [len(codes)]))


def check_markers(markers: Sequence[str]) -> None:
    """Three texts, of which none can begin inside another; only then is an output read in one way."""
    if len(markers) != 3 or not all(markers):
        raise ValueError("three markers are needed")
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if any(b.startswith(a[k:]) for k in range(1, len(a))) or (i != j and b in a):
                raise ValueError(f"markers {a!r} and {b!r} can overlap")


def _cut(unit: str, percent: int, spm_percent: int, markers: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after, between = map(codes_of, markers)
        for doc_id, text, *hashes in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for i, t, h1, h2, h3, h4 in zip(doc_id, text, *hashes):
                codes = codes_of(t)
                at = boundaries(codes, unit)
                n = len(at) - 1
                form, prefix, middle, made = "plain", None, None, t
                if n and h3 % 100 < percent and not any(m in t for m in markers):
                    a, b = at[sorted((h1 % (n + 1), h2 % (n + 1)))]
                    form, prefix, middle = "spm" if h4 % 100 < spm_percent else "psm", a, b - a
                    parts = {"psm": (before, codes[:a], after, codes[b:]), "spm": (after, codes[b:], before, codes[:a])}[form]
                    made = np.concatenate((*parts, between, codes[a:b])).tobytes().decode("utf-32-le")
                for column, value in zip(out, (i, n, form, prefix, middle, made)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", percent: int = PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are rearranged, ``spm_percent`` of them with the suffix first. ``form`` is ``plain`` for all
    others and for texts that are null, empty or hold a marker; their output is the text (null: empty) and the two lengths are
    null. All choices hang on ``seed`` and the id (null: the empty text), so repeated rows and reruns agree. Other
    columns are not read, no row moves between tasks, an empty table gives no rows.
    """
    check_markers(markers)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *hashes)
    return rows.mapInArrow(_cut(unit, percent, spm_percent, tuple(markers)), _FIELDS)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from which an output was made. Pieces hold no marker, so the first of each is the one that was put in."""
    out, (p, s, m) = F.col(output), markers
    until = lambda marker: F.substring_index(out, marker, 1)
    last = lambda text, marker: F.substring_index(text, marker, -1)
    middle = last(out, m)
    psm = F.concat(last(until(s), p), middle, last(until(m), s))
    spm = F.concat(last(until(m), p), middle, last(until(p), s))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLES = {
    "op11_fill_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents),
h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(units) + 1) AS r1,
         CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(units) + 1) AS r2, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS r4
  FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                 WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(r1, r2)], '') AS prefix, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
         array_to_string(units[greatest(r1, r2) + 1:n], '') AS suffix
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM f"""
}
