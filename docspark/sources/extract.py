"""Page extractors: each makes pages of text from the bytes of a file. Bring your own (for PDF files, say); of all that give
something, operators.ingest.extraction_winner chooses the best for each file."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.ingest import extraction_scores, extraction_winner


class Extractor(Protocol):
    name: str

    def __call__(self, content: bytes) -> list[str]: ...


class TextPages:
    """Text in UTF-8, pages parted by form feeds."""

    name = "text"

    def __call__(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class FlatText:
    """Text of any encoding as one page without line ends; what can't be read is left out."""

    name = "flat"

    def __call__(self, content: bytes) -> list[str]:
        return [" ".join(content.decode("utf-8", "ignore").split())]


class HtmlText:
    """The text of an HTML page, blocks as paragraphs; other files give nothing."""

    name = "html"
    _out = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")
    _block = re.compile(r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|section|article|blockquote)\b[^>]*>")
    _line = re.compile(r"(?i)<(?:br|li|tr)\b[^>]*>")
    _tag = re.compile(r"(?s)<[^>]*>")

    def __call__(self, content: bytes) -> list[str]:
        text = content.decode("utf-8", "replace")
        if not re.search(r"(?i)<(?:html|body|p|div|h[1-6])\b", text):
            return []
        text = self._tag.sub("", self._line.sub("\n", self._block.sub("\n\n", self._out.sub("", text))))
        lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in html.unescape(text).split("\n"))
        return [re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()]


DEFAULT = (TextPages(), HtmlText(), FlatText())


def extract(files: DataFrame, extractors: Sequence[Extractor] = DEFAULT) -> DataFrame:
    """files: (path, content) of io.read_files. (doc, extractor, extractor_ord, page, text): the pages of every extractor; one
    that fails on a file gives nothing for it. Files are read one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, e in enumerate(extractors):
                    try:
                        pages = e(content.as_py() or b"")
                    except Exception:  # noqa: BLE001  another may do
                        continue
                    if pages:
                        k = len(pages)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * k), pa.array([e.name] * k), pa.array([n] * k, pa.int32()), pa.array(range(1, k + 1), pa.int32()), pa.array(pages, pa.string())],
                            names=["doc", "extractor", "extractor_ord", "page", "text"],
                        )

    return files.select("path", "content").mapInArrow(run, "doc string, extractor string, extractor_ord int, page int, text string")


def best_pages(candidates: DataFrame) -> DataFrame:
    """(doc, page, text, extractor) of each file's best extraction."""
    best = extraction_winner(extraction_scores(candidates)).select("doc", "extractor")
    return candidates.join(best, ["doc", "extractor"]).select("doc", "page", "text", "extractor").where(F.col("text") != "")
