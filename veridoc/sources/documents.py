"""Where documents come from and go to: text files, raw pages, a store of Parquet, drawings read by machine."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.text import doc_id_for, is_doc_id, normalize_text
from veridoc.operators.spans import make_documents, verified

# Suffixes of text files; elements that break lines.
SUFFIXES = (".txt", ".md", ".markdown", ".text")
BREAKS = frozenset(("p", "div", "br", "h1", "h2", "h3", "li"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the text files of a folder (not below it): ids from names, line ends normalised, hashed."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*{" + ",".join(SUFFIXES) + "}")
    name = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return make_documents(files.select(doc_id_for(name).alias("doc_id"), normalize_text(F.col("value")).alias("text")))


def write_store(docs: DataFrame, path: str) -> None:
    """Documents as Parquet; ids that could leave the store raise."""
    bad = F.raise_error(F.concat(F.lit("illegal document id: "), F.coalesce("doc_id", F.lit("null")))).cast("string")
    docs.withColumn("doc_id", F.when(is_doc_id(F.col("doc_id")), F.col("doc_id")).otherwise(bad)).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store; reading a text that doesn't have its hash raises."""
    return verified(spark.read.parquet(path))


#: One piece of markup: a comment, a tag with its name and attributes, or a declaration.
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:[^'\">]|'[^']*'|\"[^\"]*\")*>|<[!?][^>]*>", re.DOTALL)
#: Which events of an element break a line, outside of cells for the second kind.
ALWAYS = {("tr", True), ("tr", False), ("table", True), ("table", False)}
OUTSIDE = {(tag, True) for tag in BREAKS} | {("p", False), ("div", False)}


def _events(html: str) -> Iterator[tuple[str, str, bool]]:
    """(text before, tag, opening) of every tag that matters, contents of scripts and styles left out; the last has no tag."""
    at, hidden = 0, ""
    pending: list[str] = []
    for m in MARKUP.finditer(html):
        tag, closing = (m["tag"] or "").lower(), bool(m["end"])
        if hidden:
            if not (closing and tag == hidden):
                continue
            hidden = ""
        else:
            pending.append(html[at : m.start()])
        at = m.end()
        if tag in ("script", "style") and not closing:
            hidden = tag
        elif tag in KNOWN:
            yield "".join(map(entities.unescape, pending)), tag, not closing
            pending = []
            if m[0].endswith("/>") and not closing:
                yield "", tag, False
    if not hidden:
        pending.append(html[at:])
    yield "".join(map(entities.unescape, pending)), "", False


KNOWN = BREAKS | {"td", "th", "tr", "table"}


def html_to_text(html: str | None) -> str | None:
    """Visible text of a page: blocks break lines, but are spaces within table cells; rows and tables break always."""
    if html is None:
        return None
    out, depth = [], 0
    for text, tag, opening in _events(html):
        cell = tag in ("td", "th")
        depth = max(0, depth + (1 if opening else -1)) if cell else depth
        gap = " " if cell and opening else "\n" if (tag, opening) in ALWAYS else (" " if depth else "\n") if (tag, opening) in OUTSIDE else ""
        out += (text, gap)
    # entities may be written twice over; spaces of all widths are spaces, and breaks come two at most
    text = re.sub(r"[ \t\u00a0\u2007\u2009\u202f]+", " ", entities.unescape("".join(out)))
    return re.sub(r"\n{3,}", "\n\n", text.replace("\n ", "\n"))


def pages_to_texts(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text) of raw pages: a parser has to walk the tags, in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_to_text(h.as_py()) for h in batch.column(1)], pa.string())], names=["page_id", "text"])

    return pages.select(pages[page_id].cast("long").alias("page_id"), pages[html].alias("html")).mapInArrow(run, "page_id long, text string")


def slice_sections(docs: DataFrame, start: str, end: str) -> DataFrame:
    """(doc_id, section) between two anchors, the second sought after the first; null if either is missing."""
    a = F.position(F.lit(start), F.col("canonical_text"))
    b = F.position(F.lit(end), F.col("canonical_text"), a + len(start))
    return docs.select("doc_id", F.when((a > 0) & (b > 0), F.substring("canonical_text", a, b - a)).alias("section"))


def tesseract_observations(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Words of Tesseract's TSV output as observations, shares of the sheet from its lower left corner."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    n = {c: F.col(c).cast("double") for c in ("left", "top", "width", "height", "conf")}
    rows = rows.where((n["conf"] >= 0) & (F.btrim("text") != ""))
    return rows.select(F.btrim("text").alias("text"), F.round(n["conf"] / 100, 3).alias("confidence"), F.round(n["left"] / width, 4).alias("x"), F.round(1 - (n["top"] + n["height"]) / height, 4).alias("y"), F.round(n["width"] / width, 4).alias("w"), F.round(n["height"] / height, 4).alias("h"))


def quad_observations(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Observations of (quad array<array<double>>, text, confidence), the corners in pixels from the upper left."""
    xs, ys = F.transform("quad", lambda p: p[0]), F.transform("quad", lambda p: p[1])
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return rows.select("text", F.round("confidence", 3).alias("confidence"), F.round(lo_x / width, 4).alias("x"), F.round(1 - hi_y / height, 4).alias("y"), F.round((hi_x - lo_x) / width, 4).alias("w"), F.round((hi_y - lo_y) / height, 4).alias("h"))


MANIFEST = "pages array<struct<page:int,file:string,image_sha256:string,fig_labels:array<struct<fig:string,confidence:double,x:double,y:double>>,has_header:boolean,numerals:array<struct<numeral:string,source_text:string,confidence:double,x:double,y:double,w:double,h:double,method:string,engines:array<string>,angles:array<int>>>>>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(marks, figure labels) of the pages of a drawings manifest."""
    pages = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("pages").alias("p"))
    marks = pages.select("p.page", F.posexplode("p.numerals").alias("i", "n")).select((F.col("page").cast("long") * 100_000 + F.col("i")).alias("mark_id"), "page", "n.*")
    labels = pages.select("p.page", F.explode("p.fig_labels").alias("l")).select("page", "l.fig", "l.confidence")
    return marks, labels


def raster_drift(spark: SparkSession, manifest_pages: DataFrame, folder: str) -> DataFrame:
    """Pages (page, file, image_sha256) whose image file is there and doesn't have its hash."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.sha2("content", 256).alias("now"))
    return manifest_pages.join(files, "file").where("now <> image_sha256").select("page", "file")


def read_log(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Entries of a JSON-lines log from a position on."""
    return spark.read.schema("seq long, prev_hash string, payload string, entry_hash string").json(path).where(F.col("seq") >= offset)
