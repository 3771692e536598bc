"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens lose nothing, so their spans in the
text follow from their lengths. Sections cover the text without gaps: one begins at 0
and one behind each separator, which belongs to the section that it ends. Token spans
are joined to section spans; a token that crosses a boundary goes to the section that
holds most of its bytes, and of equals to the first. So each token counts once, and a
document's sections add up to its tokens, which encoding section by section doesn't
give.

Cases: a null or empty text is one section without tokens; a text that ends with a
separator has an empty last section; repeated rows are counted each for itself; a null
doc_id stays null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary_path

SEPARATOR = "\n"
SCHEMA = "doc_id long, section int, first_char long, n_chars long, n_tokens long, n_crossing long"


def section_starts(raw: bytes, separator: bytes) -> list[int]:
    """Byte offsets where the sections of a text begin."""
    starts, at = [0], raw.find(separator)
    while at >= 0:
        starts.append(at + len(separator))
        at = raw.find(separator, at + len(separator))
    return starts


def attribute(starts: np.ndarray, total: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. ends: of the tokens, in order; the first begins at 0 and the last ends at total."""
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    edges = np.append(starts, total)
    for i in crossing.tolist():
        k = np.arange(first[i], last[i] + 1)
        held = np.minimum(edges[k + 1], ends[i]) - np.maximum(edges[k], begins[i])
        first[i] = k[int(held.argmax())]
    n = len(starts)
    return np.bincount(first, minlength=n), np.bincount(first[crossing], minlength=n)


def _counter(vocabulary: str, separator: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        if not made.spaced:
            raise ValueError("a byte-level vocabulary is needed, whose tokens cover the text")
        sizes = made.token_bytes
        for whole in batches:
            for batch in common.slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, counts = made.encode(texts)
                lengths, upto = sizes[ids], np.append(0, np.cumsum(counts))
                docs, columns = [], []
                for d, text in enumerate(texts):
                    raw = text.encode()
                    starts = np.array(section_starts(raw, separator))
                    tokens, crossing = attribute(starts, len(raw), np.cumsum(lengths[upto[d] : upto[d + 1]]))
                    if len(raw) != len(text):  # characters before each byte
                        before = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
                        edges = before[np.append(starts, len(raw))]
                    else:
                        edges = np.append(starts, len(raw))
                    docs += [d] * len(starts)
                    columns.append((np.arange(len(starts)), edges[:-1], np.diff(edges), tokens, crossing))
                section, *rest = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(docs)).cast(pa.int64()), pa.array(section, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def count(docs: DataFrame, vocabulary: str | None = None, separator: str = SEPARATOR) -> DataFrame:
    """A row for each section of each document: where it lies, its tokens, and how many of them cross its boundary. docs: doc_id, text."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    return docs.select("doc_id", "text").mapInArrow(_counter(path, separator.encode()), SCHEMA)


def per_document(sections: DataFrame) -> DataFrame:
    """Sums over the sections of each doc_id."""
    return sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"), F.sum("n_crossing").alias("n_crossing"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(common.table(spark, sf_dir, "documents"))
