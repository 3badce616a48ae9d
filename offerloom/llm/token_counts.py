"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. Its sections are spans of characters that cover it in order; each token goes to
the section that holds the token's first character, also if the token reaches into the next section. The counts of a
document's sections therefore add up to the tokens of the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.packing import encoder
from offerloom.llm.texts import release, table

_FIELDS = "doc_id long, section long, start long, stop long, tokens long, crossing long, doc_tokens long"


def line_starts(text: str) -> np.ndarray:
    """Where each line begins, in characters; a line ends with its line feed."""
    lengths = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def section_starts(given: list[int | None], length: int) -> np.ndarray:
    """Ascending distinct starts inside the text, with 0 before them; nulls and places outside the text are left out."""
    return np.unique([0, *(s for s in given if s is not None and 0 < s < length)])


def _attribute(path: str | None, ranks: str | None, as_given: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text, given in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(3))):
                    first = own.first_chars(text, own.ids(text))
                    starts = line_starts(text) if given is None else np.array(given, np.int64) if as_given else section_starts(given, len(text))
                    stops = np.append(starts[1:], len(text))
                    section = np.searchsorted(starts, first, "right") - 1
                    # a token ends where the next one begins
                    late = np.append(first[1:], len(text)) > stops[section]
                    n = len(starts)
                    tokens, crossing = np.bincount(section, minlength=n), np.bincount(section[late], minlength=n)
                    for column, value in zip(out, ([doc_id] * n, range(n), starts, stops, tokens, crossing, [len(first)] * n)):
                        column.extend(value)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "section", "start", "stop", "tokens", "crossing", "doc_tokens"])
        release()

    return run


def attribute_tokens(docs: DataFrame, sections: str | None = None, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start, stop, tokens, crossing, doc_tokens.

    ``sections`` names an array column with the character starts of a document's sections; without it, and where it is
    null, a section is a line. Starts may come in any order: nulls, repeated ones and those outside the text are left out, and
    a section begins at 0 in any case, so an empty array is one section. ``crossing`` counts the tokens given to a section that
    end in a later one. A null or empty text is one empty section without tokens. Repeated rows are counted each; other
    columns are not read; an empty table gives no rows.
    """
    spans = F.col(sections).cast("array<long>") if sections else F.lit(None).cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), spans.alias("spans"))
    return rows.mapInArrow(_attribute(path, ranks), _FIELDS)


def attribute_to_fields(docs: DataFrame, fields: Sequence[str], separator: str = "\n", path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document and field: doc_id, field, start, stop, tokens, crossing, doc_tokens.

    The fields are encoded as one text, in the given order with the separator after each but the last; a separator belongs to
    the field before it. Null fields are empty and get their row, with no tokens but those that begin in their separator.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    start, starts = F.lit(0), []
    for text in texts:
        starts.append(start)
        start = start + F.char_length(text) + len(separator)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws(separator, *texts).alias("text"), F.array(*starts).cast("array<long>").alias("spans"))
    counted = rows.mapInArrow(_attribute(path, ranks, True), _FIELDS)
    return counted.select("doc_id", F.element_at(F.lit(list(fields)), (F.col("section") + 1).cast("int")).alias("field"), "start", "stop", "tokens", "crossing", "doc_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return attribute_tokens(table(spark, sf_dir))
