"""Raw files to documents: dispatch by type, one Arrow pass, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import text as T
from fathomline.sources.formats import html, office, pdf, plain
from fathomline.sources.formats.document import Document, ExtractionError

EXTRACTORS: dict[str, Callable[[bytes], Document]] = {"html": html.extract, "pdf": pdf.extract, "docx": office.word, "pptx": office.slides, "text": plain.extract}

_ASSET = "struct<bytes:binary,content_type:string,page_number:int,label:string>"
SCHEMA = f"id string, format string, full_text string, pages array<struct<page_number:bigint,text:string>>, assets array<{_ASSET}>, error_code string, error string"
#: Bytes of files that a partition should hold: files are spread before extraction, as one read split may hold many.
PARTITION_BYTES = 64 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, content) of the files under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def extract(files: DataFrame) -> DataFrame:
    """The documents of files (id, file_type, content), one row each.

    A type without an extractor, null content and files that can't be read give a row with error_code and error and null
    text. Empty files of text are empty documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("page_number", pa.int64()), ("text", pa.string())])), pa.list_(pa.struct([("bytes", pa.binary()), ("content_type", pa.string()), ("page_number", pa.int32()), ("label", pa.string())])), pa.string(), pa.string())
        names = ["id", "format", "full_text", "pages", "assets", "error_code", "error"]
        for batch in batches:
            for i, name, data in zip(*(batch.column(c).to_pylist() for c in ("id", "format", "content")), strict=True):
                row: tuple
                try:
                    if name not in EXTRACTORS:
                        raise ExtractionError("unsupported_format", "no extractor takes this type")
                    if data is None:
                        raise ExtractionError("corrupted_file", "no content")
                    d = EXTRACTORS[name](data)
                    row = (i, name, d.full_text, [{"page_number": p.page_number, "text": p.text} for p in d.pages], [vars(a) for a in d.all_assets()], None, None)
                except ExtractionError as e:
                    row = (i, name, None, [], [], e.code, str(e))
                except (ValueError, KeyError, TypeError, IndexError, RecursionError) as e:  # a malformed file is a row, not a lost task
                    row = (i, name, None, [], [], "corrupted_file", repr(e)[:200])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    return files.select("id", S.extractor(F.col("file_type")).alias("format"), "content").mapInArrow(run, SCHEMA)


def flat_assets(documents: DataFrame) -> DataFrame:
    """(file_id, ordinal, asset_type, content_type, page_number, label, byte_size, bytes) of all documents' assets."""
    one = documents.select(F.col("id").alias("file_id"), F.posexplode("assets").alias("ordinal", "a"))
    kind = F.when(F.col("a.content_type").startswith("image/"), "image").otherwise("other")
    return one.select("file_id", "ordinal", kind.alias("asset_type"), "a.content_type", "a.page_number", "a.label", F.octet_length("a.bytes").alias("byte_size"), "a.bytes")


def nested_page_assets(documents: DataFrame) -> DataFrame:
    """pending (array of asset structs) and pages (with assets) flattened: the document's first, pages give their number."""
    own = F.flatten(F.transform("pages", lambda p: F.transform(p["assets"], lambda a: F.struct(a["label"].alias("label"), F.coalesce(a["page_number"], p["page_number"]).alias("page_number")))))
    return documents.select("id", F.concat(F.transform("pending", lambda a: F.struct(a["label"].alias("label"), a["page_number"].alias("page_number"))), own).alias("assets"))


def transcripts(snippets: DataFrame) -> DataFrame:
    """(video_id, lang, text, error): each video's transcript in English if there is one, else in its first language.

    snippets: (video_id, lang, start, duration, text). Lines are [start-end s] text in order of start. A video without a
    line that has text has a null text and the error no_transcript.
    """
    w = F.col("lang") == "en"
    choice = snippets.groupBy("video_id").agg(F.min(F.struct((~F.coalesce(w, F.lit(False))).alias("other"), F.col("lang"))).alias("c")).select("video_id", F.col("c.lang").alias("lang"))
    chosen = snippets.join(choice, (snippets["video_id"].eqNullSafe(choice["video_id"])) & snippets["lang"].eqNullSafe(choice["lang"]), "left_semi")
    line = T.transcript_line(F.col("start"), F.col("duration"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("start", F.when(~T.is_empty(F.col("text")), line).alias("line"))))
    lines = F.filter(F.transform(listed, lambda x: x["line"]), lambda x: x.isNotNull())
    out = chosen.groupBy("video_id").agg(F.min("lang").alias("lang"), F.array_join(lines, "\n").alias("text"))
    return out.select("video_id", "lang", F.when(F.length("text") > 0, F.col("text")).alias("text"), F.when(F.length("text") == 0, S.transcript_error(F.lit("no_transcript_found"))).alias("error"))
