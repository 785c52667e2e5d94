"""Chunking, text functions and extraction."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import text as T
from fathomline.functions import urls as U
from fathomline.operators import chunking as C
from fathomline.operators.embedding import HashProvider, embedded
from fathomline.plans import tables as P
from fathomline.plans.tables import sql
from fathomline.sources import extract as X
from fathomline.storage import read, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Unicode White_Space in DuckDB's regular expressions.
_SP = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _w(text: str) -> str:
    return f"list_filter(regexp_split_to_array(replace({text}, chr(0), ''), '{_SP}+'), lambda w: w <> '')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SP}+|{_SP}+$', '', 'g')"


def _windows(size: int, overlap: int, least: int, more: str = "") -> str:
    stride = size - overlap
    return f"""WITH d AS (SELECT doc_id, {_w('text')} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - {size}) / {stride}::DOUBLE))::INT))::INT AS chunk_index FROM d WHERE len(w) > 0),
y AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * {stride} + 1 : chunk_index * {stride} + {size}], ' ') AS chunk_text, len(w[chunk_index * {stride} + 1 : chunk_index * {stride} + {size}])::INT AS token_count FROM x)
SELECT doc_id, chunk_index, token_count, sha256(chunk_text) AS digest FROM y WHERE strlen(chunk_text) >= {least}{more}"""


def _chunks(spark: SparkSession, root: str, config: C.ChunkConfig) -> DataFrame:
    docs = spread(read(spark, root, "documents").select("doc_id", "text"))
    return C.word_chunks(docs, config).select("doc_id", "chunk_index", "token_count", T.sha256(F.col("chunk_text")).alias("digest"))


@query(_windows(578, 102, 10))
def chunk_words_default(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root, C.ChunkConfig())


@query(_windows(200, 50, 100))
def chunk_words_small(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root, C.ChunkConfig(200, 50, None, 100))


@query(_windows(200, 50, 100, " AND chunk_index < 3"))
def chunk_words_capped(spark: SparkSession, root: str) -> DataFrame:
    """The configuration's own cap of chunks a document, where one is set."""
    return _chunks(spark, root, C.ChunkConfig(200, 50, 3, 100))


@query(f"WITH d AS (SELECT doc_id, len({_w('text')})::INT AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n AS n_words, n AS n_covered FROM d WHERE n > 0")
def chunk_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Words that the windows of a document cover: all of them, when no window is dropped."""
    docs = spread(read(spark, root, "documents").select("doc_id", "text")).withColumn("n_words", T.word_count(T.sanitize(F.col("text"))))
    rows = C.word_chunks(docs, C.ChunkConfig(200, 50, None, 0)).groupBy("doc_id")  # ids are unique: no text is moved
    return rows.agg(F.max("n_words").alias("n_words"), F.max(F.col("chunk_index") * 150 + F.col("token_count")).alias("n_covered"))


@query(sql("c", f" SELECT id, len({_w('chunk_text')})::INT AS n_words, strlen(chunk_text)::INT AS n_bytes, length({_strip('chunk_text')}) = 0 AS is_empty, len({_w('chunk_text')}) >= 3 AS is_meaningful FROM c WHERE chunk_text IS NOT NULL"))
def chunk_stats(spark: SparkSession, root: str) -> DataFrame:
    t = T.sanitize(F.col("chunk_text"))
    c = P.table(spark, root, "content_chunks").where(F.col("chunk_text").isNotNull())
    return c.select("id", T.word_count(t).alias("n_words"), T.byte_length(F.col("chunk_text")).alias("n_bytes"), T.is_empty(F.col("chunk_text")).alias("is_empty"), T.is_meaningful(t).alias("is_meaningful"))


@query(sql("c", f" SELECT id, sha256(array_to_string(list_filter(list_transform(string_split(replace(chunk_text, chr(0), ''), chr(10)), lambda x: regexp_replace(x, '{_SP}+$', '')), lambda x: x <> ''), chr(10))) AS digest FROM c WHERE chunk_text IS NOT NULL"))
def text_sanitize(spark: SparkSession, root: str) -> DataFrame:
    """Digests of the texts without U+0000, white space at line ends and empty lines."""
    c = P.table(spark, root, "content_chunks").where(F.col("chunk_text").isNotNull())
    return c.select("id", T.sha256(T.tidy_lines(T.sanitize(F.col("chunk_text")))).alias("digest"))


@query(sql("c", f" SELECT id, length(regexp_replace(chunk_text, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}!-~\\x{{A1}}-\\x{{FF}}]', '', 'g'))::INT AS n_kept FROM c WHERE chunk_text IS NOT NULL"))
def page_text_filter(spark: SparkSession, root: str) -> DataFrame:
    """Characters that the filter of page texts keeps."""
    c = P.table(spark, root, "content_chunks").where(F.col("chunk_text").isNotNull())
    return c.select("id", F.length(T.printable(F.col("chunk_text"))).alias("n_kept"))


@query("WITH x AS (SELECT doc_id, '&amp;lt;' || replace(replace(text, '.', '&amp;'), ',', '&quot;&gt;') AS xml FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(replace(replace(replace(replace(replace(xml, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')) AS digest FROM x")
def xml_unescape(spark: SparkSession, root: str) -> DataFrame:
    xml = F.concat(F.lit("&amp;lt;"), F.replace(F.replace("text", F.lit("."), F.lit("&amp;")), F.lit(","), F.lit("&quot;&gt;")))
    return read(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.sha256(T.unescape_xml(xml)).alias("digest"))


@query("WITH x AS (SELECT p_partkey, 'ppt/slides/slide' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN 'x' || p_partkey ELSE '00' || p_partkey END || '.xml' AS name FROM part) SELECT p_partkey, coalesce(try_cast(regexp_extract(name, '^(?:ppt/slides/slide)+([0-9]+)(?:\\.xml)+$', 1) AS BIGINT), 4294967295) AS number FROM x")
def slide_number_parse(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    middle = F.when(k % 4 == 0, "").when(k % 4 == 1, s).when(k % 4 == 2, F.concat(F.lit("x"), s)).otherwise(F.concat(F.lit("00"), s))
    return read(spark, root, "part").select("p_partkey", T.slide_number(F.concat(F.lit("ppt/slides/slide"), middle, F.lit(".xml"))).alias("number"))


_HOST = "regexp_extract(file_path, '^[a-z]+://([^/?#]+)', 1)"
_PATH = "regexp_extract(file_path, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(sql("f", f", u AS (SELECT id, file_path, string_split({_PATH}, '/')[-1] AS last FROM f WHERE file_path LIKE 'http%') SELECT id, CASE WHEN last <> '' THEN last ELSE {_HOST} || '_webpage_0' END AS name FROM u"))
def url_file_name(spark: SparkSession, root: str) -> DataFrame:
    f = P.files(spark, root).where(F.col("file_path").startswith("http"))
    return f.select("id", U.file_name(F.col("file_path"), F.lit(0)).alias("name"))


@query(sql("f", ", u AS (SELECT id, CASE WHEN file_size % 3 = 0 THEN replace(file_path, 'tube.lumenry.example', 'www.youtube.com') WHEN file_size % 3 = 1 THEN replace(file_path, 'tube.lumenry.example/watch?v=', 'youtu.be/') ELSE file_path END AS url FROM f WHERE file_path LIKE '%tube.lumenry%') SELECT id, CASE WHEN url LIKE '%//www.youtube.com/%' THEN nullif(regexp_extract(url, '[?&]v=([^&#]*)', 1), '') WHEN url LIKE '%//youtu.be/%' THEN nullif(regexp_extract(url, '//youtu.be/([^?#]*)', 1), '') END AS video_id FROM u"))
def youtube_video_id(spark: SparkSession, root: str) -> DataFrame:
    f = P.files(spark, root).where(F.col("file_path").contains("tube.lumenry"))
    n = F.col("file_size") % 3
    url = F.when(n == 0, F.replace("file_path", F.lit("tube.lumenry.example"), F.lit("www.youtube.com"))).when(n == 1, F.replace("file_path", F.lit("tube.lumenry.example/watch?v="), F.lit("youtu.be/"))).otherwise(F.col("file_path"))
    return f.select("id", U.video_id(url).alias("video_id"))


@query("SELECT doc_id, CASE WHEN title IS NULL OR title = '' OR contains(title, '<') THEN NULL ELSE trim(title) END AS title FROM documents")
def html_title(spark: SparkSession, root: str) -> DataFrame:
    html = F.concat(F.lit("<html><head><title lang='x'> "), F.coalesce("title", F.lit("")), F.lit("</title></head></html>"))
    d = read(spark, root, "documents")
    plain = F.coalesce(F.col("title").contains("<") | (F.col("title") == ""), F.lit(True))
    return d.select("doc_id", F.when(~plain, T.html_title(html)).alias("title"))


@query(sql("f", " SELECT id, CASE WHEN lower(file_type) IN ('text/html', 'application/html', 'text/htm') THEN 'html' WHEN lower(file_type) = 'application/pdf' THEN 'pdf' WHEN lower(file_type) IN ('text/youtube-url', 'text/youtube-transcript', 'application/youtube') THEN 'youtube' WHEN lower(file_type) LIKE '%wordprocessingml.document' THEN 'docx' WHEN lower(file_type) LIKE '%presentationml.presentation' THEN 'pptx' WHEN lower(file_type) IN ('text/plain', 'text/txt', 'txt', 'plain') THEN 'text' END AS extractor FROM f"))
def extractor_dispatch(spark: SparkSession, root: str) -> DataFrame:
    return P.files(spark, root).select("id", S.extractor(F.col("file_type")).alias("extractor"))


@query(sql("a", " SELECT id, CASE lower(string_split(label, '.')[-1]) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' WHEN 'webp' THEN 'image/webp' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'svg' THEN 'image/svg+xml' WHEN 'emf' THEN 'image/emf' WHEN 'wmf' THEN 'image/wmf' ELSE 'application/octet-stream' END AS content_type FROM a"))
def asset_content_type(spark: SparkSession, root: str) -> DataFrame:
    return P.assets(spark, root).select("id", T.content_type(F.col("label")).alias("content_type"))


@query("SELECT p_partkey % 200 AS file_id, count(*) AS n_assets, sum(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size END)::BIGINT AS pages FROM part GROUP BY 1")
def asset_flatten(spark: SparkSession, root: str) -> DataFrame:
    """Assets of documents and of pages as one list; those of pages inherit the page's number."""
    p = read(spark, root, "part").select((F.col("p_partkey") % 200).alias("id"), F.col("p_name").alias("label"), F.col("p_size").cast("int").alias("page_number"), (F.col("p_partkey") % 3 == 0).alias("own"))
    bare = F.struct(F.col("label"), F.lit(None).cast("int").alias("page_number"))
    docs = p.groupBy("id").agg(F.collect_list(F.when(F.col("own"), bare)).alias("pending"), F.collect_list(F.when(~F.col("own"), F.struct("page_number", F.array(bare).alias("assets")))).alias("pages"))
    flat = X.nested_page_assets(docs).select("id", F.explode("assets").alias("a"))
    return flat.groupBy(F.col("id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_assets"), F.sum(F.coalesce("a.page_number", F.lit(-1)).cast("bigint")).alias("pages"))


@query("SELECT (user_id)::VARCHAR AS video_id, count(*) AS n_lines, sha256(list_aggregate(list(printf('[%.1f-%.1fs] %s', event_id * 5.0, event_id * 5.0 + 4.5, event_type) ORDER BY event_id), 'string_agg', chr(10))) AS digest FROM events GROUP BY user_id")
def transcript_lines(spark: SparkSession, root: str) -> DataFrame:
    e = read(spark, root, "events")
    s = e.select(F.col("user_id").cast("string").alias("video_id"), F.lit("en").alias("lang"), (F.col("event_id") * 5.0).cast("double").alias("start"), F.lit(4.5).cast("double").alias("duration"), F.col("event_type").alias("text"))
    t = X.transcripts(s)
    return t.select("video_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), T.sha256(F.col("text")).alias("digest"))


@query(sql("f", ", k AS (SELECT id, 'file_name=' || file_name || '&tenant=' || tenant_id || 'secret' AS s FROM f) SELECT id, sha1(s) AS signature FROM k"))
def signature_sha1(spark: SparkSession, root: str) -> DataFrame:
    params = F.create_map(F.lit("tenant"), F.col("tenant_id"), F.lit("file_name"), F.col("file_name"))
    return P.files(spark, root).select("id", T.signature(params, F.lit("secret")).alias("signature"))


@query(sql("f", f" SELECT id, length(regexp_replace(file_name, '{_SP}', '', 'g')) > 0 AND NOT contains(file_name, '/') AND NOT contains(file_name, '..') AS is_safe, CASE WHEN regexp_full_match(file_hash, '[0-9a-fA-F]{{64}}') THEN lower(file_hash) END AS hash FROM f"))
def file_name_checks(spark: SparkSession, root: str) -> DataFrame:
    return P.files(spark, root).select("id", U.is_safe_name(F.col("file_name")).alias("is_safe"), T.valid_hash(F.col("file_hash")).alias("hash"))


@query(f"SELECT doc_id, length({_strip('text')}) > 0 AND strlen(text) <= 1048576 AS fits FROM documents WHERE text IS NOT NULL")
def text_blob_limits(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.fits_blob(F.col("text")).alias("fits"))


@query(sql("f", " SELECT id, status, CASE WHEN lower(trim(processing_status)) LIKE 'failed:%' THEN trim(regexp_replace(trim(processing_status), '^[^:]*:', '')) END AS message, CASE status WHEN 'processing' THEN 50 WHEN 'completed' THEN 100 ELSE 0 END::INT AS percentage FROM f"))
def status_normalize(spark: SparkSession, root: str) -> DataFrame:
    return P.files(spark, root).select("id", "status", S.message(F.col("processing_status")).alias("message"), S.percentage(F.col("status")).alias("percentage"))


@query("WITH s AS (SELECT unnest(['pending','processing','completed','failed']) AS x) SELECT a.x AS old, b.x AS new, (a.x || '>' || b.x) IN ('pending>processing','processing>completed','processing>failed','failed>pending') AS allowed FROM s a, s b")
def status_transition_matrix(spark: SparkSession, root: str) -> DataFrame:
    states = F.array(*map(F.lit, S.STATES))
    return spark.range(1).select(F.explode(states).alias("old"), states.alias("n")).select("old", F.explode("n").alias("new")).withColumn("allowed", S.may_step(F.col("old"), F.col("new")))


@query()
def split_recursive(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(read(spark, root, "documents").select("doc_id", "text"))
    return C.recursive_chunks(docs, 2000).select("doc_id", "chunk_index", "token_count", "chunk_text")


def _archive(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


@query()
def extract_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text wrapped as HTML, Word, PowerPoint or text by turns, and extracted again."""
    from fathomline.sources.formats.office import _W

    @F.pandas_udf("binary")
    def wrap(numbers: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else wrapped(int(n), t) for n, t in zip(numbers, texts, strict=True)])

    def wrapped(n: int, text: str) -> bytes:
        clean = escape("".join(c for c in text if c >= " " or c == "\n"))
        paragraphs = clean.split("\n")
        if n % 4 == 0:
            return ("<html><head><title>t</title></head><body>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</body></html>").encode()
        if n % 4 == 1:
            return _archive({"word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>", "word/media/a.png": "x"})
        if n % 4 == 2:
            return _archive({f"ppt/slides/slide{k}.xml": f"<p:sld><a:t>{p}</a:t></p:sld>" for k, p in enumerate(paragraphs, 1)})
        return text.encode()

    d = read(spark, root, "documents")
    kinds = F.array(F.lit("text/html"), F.lit("application/vnd.openxmlformats-officedocument.wordprocessingml.document"), F.lit("application/vnd.openxmlformats-officedocument.presentationml.presentation"), F.lit("text/plain"))
    files = d.select(F.col("doc_id").cast("string").alias("id"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("file_type"), wrap("doc_id", "text").alias("content"))
    return X.extract(files).select("id", "format", T.word_count(F.col("full_text")).alias("n_words"), F.size("pages").alias("n_pages"), F.size("assets").alias("n_assets"), "error_code")


@query()
def embed_local(spark: SparkSession, root: str) -> DataFrame:
    c = P.table(spark, root, "content_chunks").select("id", "chunk_text")
    e = embedded(c, HashProvider)
    return e.select("id", F.size("embedding").alias("dimension"), "model_name", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"))


# Texts as one line of words, without control characters; what is put into files and must come out of them again.
_LINE = "array_to_string({}, ' ')".format(_w(r"regexp_replace(text, '[\x{01}-\x{08}\x{0E}-\x{1F}\x{7F}]', '', 'g')"))
_ASCII = "regexp_replace(regexp_replace({}, '[^ -~]', '', 'g'), ' +', ' ', 'g')".format(_LINE)


def _lines(spark: SparkSession, root: str) -> DataFrame:
    clean = F.regexp_replace("text", r"[\x00-\x08\x0E-\x1F\x7F]", "")
    return read(spark, root, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), F.array_join(T.words(clean), " ").alias("line"))


def _extracted(lines: DataFrame, mime: str, wrap) -> DataFrame:
    """(id, format, n_pages, digest): the lines made to files, extracted, and their words joined again."""
    made = F.pandas_udf(lambda s: pd.Series([wrap(x) for x in s]), "binary")
    files = lines.select("id", F.lit(mime).alias("file_type"), made("line").alias("content"))
    return X.extract(files).select("id", "format", F.size("pages").alias("n_pages"), T.sha256(F.array_join(T.words(F.col("full_text")), " ")).alias("digest"), "error_code")


def _extraction_sql(name: str, pages: str, line: str = _LINE) -> str:
    return f"SELECT doc_id::VARCHAR AS id, '{name}' AS format, {pages}::INT AS n_pages, sha256({line}) AS digest, NULL::VARCHAR AS error_code FROM documents WHERE text IS NOT NULL"


@query(_extraction_sql("text", "0"))
def extract_plain(spark: SparkSession, root: str) -> DataFrame:
    return _extracted(_lines(spark, root), "text/plain", lambda x: x.encode())


@query(_extraction_sql("html", "0"))
def html_to_text(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose head has no end tag, with markup and a script around the text."""
    return _extracted(_lines(spark, root), "text/html", lambda x: f"<html><head><title>t</title><body><div><p>{escape(x)}</p></div><script>no();</script></body></html>".encode())


@query(_extraction_sql("docx", "1"))
def extract_word(spark: SparkSession, root: str) -> DataFrame:
    """The text in two runs, the second within a hyperlink."""
    from fathomline.sources.formats.office import _W

    def wrap(x: str) -> bytes:
        at = len(x) // 2
        return _archive({"word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body><w:p><w:r><w:t xml:space="preserve">{escape(x[:at])}</w:t></w:r><w:hyperlink><w:r><w:t xml:space="preserve">{escape(x[at:])}</w:t></w:r></w:hyperlink></w:p></w:body></w:document>'})

    return _extracted(_lines(spark, root), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", wrap)


@query(_extraction_sql("pptx", "2"))
def extract_slides(spark: SparkSession, root: str) -> DataFrame:
    """The words on two slides, which are stored in the other order."""

    def wrap(x: str) -> bytes:
        words = x.split(" ")
        parts = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
        return _archive({f"ppt/slides/slide{n}.xml": f"<p:sld><a:t>{escape(part)}</a:t></p:sld>" for n, part in ((10, parts[1]), (9, parts[0]))})

    return _extracted(_lines(spark, root), "application/vnd.openxmlformats-officedocument.presentationml.presentation", wrap)


def _pdf(text: str) -> bytes:
    """A document of one page that shows text."""
    import zlib

    shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    raw = zlib.compress(f"BT /F1 12 Tf 72 700 Td ({shown}) Tj ET".encode("latin-1"))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(raw) + raw + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in enumerate(objects, 1)) + b"%%EOF"


@query(_extraction_sql("pdf", "1", f"CASE WHEN trim({_ASCII}) = '' THEN '[Page 1: No extractable text found - may contain images or corrupted text]' ELSE trim({_ASCII}) END"))
def extract_pdf(spark: SparkSession, root: str) -> DataFrame:
    """The text's printable ASCII as a PDF of one page; a page without any says so."""
    ascii_ = F.trim(F.regexp_replace(F.regexp_replace("line", "[^ -~]", ""), " +", " "))
    return _extracted(_lines(spark, root).withColumn("line", ascii_), "application/pdf", _pdf)


@query(sql("f", " SELECT id, contains(lower(file_path), 'youtube.com') OR contains(lower(file_path), 'youtu.be') AS looks, regexp_extract('postgres://user:secret@' || regexp_replace(file_path, '^[a-z]+://', '') || '?sslmode=on', '^[a-z]+://(?:[^/@]*@)?([^?#@]*)', 1) AS shown, CASE WHEN trim(file_name) <> '' THEN trim(file_name) END AS token FROM f WHERE file_path IS NOT NULL AND file_name IS NOT NULL AND NOT contains(file_path, '@') AND NOT contains(file_path, '?') AND NOT contains(file_path, '#')"))
def request_checks(spark: SparkSession, root: str) -> DataFrame:
    """The first test of a video's address, an address of a store without its secrets, and the token of a header."""
    f = P.files(spark, root).where(F.col("file_path").isNotNull() & F.col("file_name").isNotNull() & ~F.col("file_path").rlike("[@?#]"))
    address = F.concat(F.lit("postgres://user:secret@"), F.regexp_replace("file_path", "^[a-z]+://", ""), F.lit("?sslmode=on"))
    return f.select("id", U.looks_like_video(F.col("file_path")).alias("looks"), U.redacted(address).alias("shown"), U.bearer(F.concat(F.lit("Bearer "), "file_name")).alias("token"))
