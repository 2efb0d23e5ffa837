"""Page extraction from PDF files as an Arrow stage. The PDF library is optional; failures of a file become a row with its error, and other files go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPANS = (
    "doc string, page int, seq long, text string, font_size double, is_bold boolean, is_italic boolean, x0 double, y0 double, x1 double, y1 double, page_height double, error string"
)


def scan_pdfs(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(path, content) of the PDF files of a directory, or of the one file ``only`` in it (with or without .pdf); no other file is opened then."""
    if only is not None:
        path = f"{path.rstrip('/')}/{only.removesuffix('.pdf')}.pdf"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def extract_spans(files: DataFrame, extractor: Callable[[bytes], Iterator[dict]] | None = None) -> DataFrame:
    """A row per text span of (path, content); ``extractor`` turns a file's bytes into span dictionaries, by default with the PDF library if it is installed."""
    names = [f.split(" ")[0] for f in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = extractor or default_extractor
        schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("seq", pa.int64()), ("text", pa.string()), ("font_size", pa.float64()), ("is_bold", pa.bool_()), ("is_italic", pa.bool_()),
                            *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "page_height")), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                doc = path.rsplit("/", 1)[-1].removesuffix(".pdf")
                try:
                    rows = [{**dict.fromkeys(names), **span, "doc": doc, "seq": i} for i, span in enumerate(read(content))]
                except Exception as e:  # a broken file must not stop the others
                    rows = [{**dict.fromkeys(names), "doc": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, SPANS)


def default_extractor(content: bytes) -> Iterator[dict]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; give an extractor") from e
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, 1):
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", ()):
                    for span in line["spans"]:
                        x0, y0, x1, y1 = span["bbox"]
                        bold, italic = bool(span["flags"] & 16) or "Bold" in span["font"], bool(span["flags"] & 2) or "Italic" in span["font"] or "Oblique" in span["font"]
                        yield {"page": number, "text": span["text"], "font_size": span["size"], "is_bold": bold, "is_italic": italic, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "page_height": page.rect.height}
