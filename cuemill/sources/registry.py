"""Registry of formats, detection by content, and conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.config import StandardizationConfig
from cuemill.operators import standard
from cuemill.sources import document_formats as D
from cuemill.sources import text_formats as X
from cuemill.sources import transcripts

_md, _ttml = D.reader(transcripts.cues), D.reader(D.ttml)
READERS: dict[str, Callable[..., DataFrame]] = {
    "srt": X.read_srt, "vtt": X.read_vtt, "ass": X.read_ass, "ssa": X.read_ass, "sub": X.read_microdvd, "sami": X.read_sami, "smi": X.read_sami,
    "sbv": X.read_sbv, "lrc": X.read_lrc, "srv3": D.reader(D.srv3), "json": X.read_json, "json3": X.read_json3, "csv": D.reader(D.comma_rows), "tsv": X.read_tsv,
    "aud": X.read_aud, "txt": X.read_txt, "textgrid": D.reader(D.textgrid), "ttml": _ttml, "imsc1": _ttml, "ebu_tt_d": _ttml,
    "markdown": _md, "md": _md, "gemini": _md, "avid_ds": D.reader(D.avid), "fcpxml": D.reader(D.fcpxml), "premiere_xml": D.reader(D.premiere), "audition_csv": D.reader(D.audition),
}
WRITERS: dict[str, Callable[..., DataFrame]] = {
    "srt": X.write_srt, "vtt": X.write_vtt, "ass": X.write_ass, "ssa": X.write_ssa, "sub": X.write_microdvd, "sami": X.write_sami, "smi": X.write_sami,
    "sbv": X.write_sbv, "lrc": X.write_lrc, "srv3": X.write_srv3, "json": X.write_json, "json3": X.write_json3, "csv": X.write_csv, "tsv": X.write_tsv,
    "aud": X.write_aud, "txt": X.write_txt, "textgrid": X.write_textgrid, "ttml": X.write_ttml, "imsc1": X.write_imsc1, "ebu_tt_d": X.write_ebu_tt_d,
    "markdown": X.write_markdown, "md": X.write_markdown, "gemini": X.write_markdown, "avid_ds": X.write_avid, "fcpxml": X.write_fcpxml, "premiere_xml": X.write_premiere,
    "audition_csv": X.write_audition, "edimarker_csv": X.write_edimarker,
}


class FormatNotSupportedError(ValueError):
    """An id that no reader or writer is registered for."""


def register_reader(name: str, read: Callable[..., DataFrame]) -> None:
    READERS[name.lower()] = read


def register_writer(name: str, write: Callable[..., DataFrame]) -> None:
    WRITERS[name.lower()] = write


def read(docs: DataFrame, fmt: str, normalize: bool = True) -> DataFrame:
    """Cues of documents of one format."""
    try:
        return READERS[fmt.lower()](docs, normalize)
    except KeyError:
        raise FormatNotSupportedError(fmt) from None


def write(cues: DataFrame, fmt: str, **options: bool) -> DataFrame:
    try:
        return WRITERS[fmt.lower()](cues, **options)
    except KeyError:
        raise FormatNotSupportedError(fmt) from None


def output_format(fmt: str | None = None, path: str | None = None, source: str | None = None) -> str:
    """Format to be written: the one asked for, else by the path's ending, else the source's, else SRT; one without a writer is refused."""
    ending = next((f for e, f in sorted(EXTENSIONS, key=lambda x: -len(x[0])) if path and path.lower().endswith(e)), None)
    if path and path.lower().endswith((".md", ".vtt")):
        ending = "markdown" if path.lower().endswith(".md") else "vtt"
    if path and path.lower().endswith(".txt"):
        ending = "txt"
    found = (fmt or ending or source or "srt").lower()
    if found not in WRITERS:
        raise FormatNotSupportedError(found)
    return found


def render(cues: DataFrame, fmt: str | None = None, path: str | None = None, source: str | None = None, standardization: StandardizationConfig | None = None, **options: bool) -> DataFrame:
    """Documents of cues, cut for reading first where limits are given."""
    if standardization:
        pieces = standard.split_long(cues, standardization)
        order = Window.partitionBy("doc_id").orderBy("cue_idx", "part")
        cues = pieces.withColumn("cue_idx", (F.row_number().over(order) - 1).cast("int")).drop("part")
    return write(cues, output_format(fmt, path, source), **options)


def convert(docs: DataFrame, source: str, target: str) -> DataFrame:
    return write(read(docs, source), target)


def detect_format(content: Column) -> Column:
    """Format id by an ordered ladder of signatures over the head of a content; ``txt`` if none fits."""
    head = F.ltrim(F.regexp_replace(F.left(content, F.lit(4096)), "^\\x{FEFF}", ""))
    starts = lambda p: F.startswith(head, F.lit(p))
    return (
        F.when(starts("WEBVTT"), "vtt")
        .when(head.rlike("(?i)^\\[Script Info\\]"), F.when(head.rlike("(?i)v4\\.00\\+|\\[V4\\+ Styles\\]"), "ass").otherwise("ssa"))
        .when(head.rlike("<timedtext"), "srv3")
        .when(head.rlike("<tt[\\s>]"), "ttml")
        .when(head.rlike("^\\{") & head.rlike('"(?:wireMagic|events)"'), "json3")
        .when(head.rlike('^[\\[{]\\s*["{]'), "json")
        .when(head.rlike("^\\d+\\n\\d+:\\d{2}:\\d{2}[,.]\\d{1,3}\\s*-->"), "srt")
        .when(head.rlike("^\\d+:\\d{2}:\\d{2}\\.\\d{3},\\d+:\\d{2}:\\d{2}\\.\\d{3}\\n"), "sbv")
        .when(head.rlike("^\\{\\d+\\}\\{\\d+\\}"), "sub")
        .when(head.rlike("(?i)^<SAMI>"), "sami")
        .when(head.rlike("<fcpxml"), "fcpxml")
        .when(head.rlike("<xmeml"), "premiere_xml")
        .when(head.rlike("(?i)^(?:speaker,)?start,end"), "csv")
        .when(head.rlike("(?i)^(?:speaker\\t)?start\\tend"), "tsv")
        .when(head.rlike("^\"?Name\"?[,\\t]\"?Start\"?[,\\t]\"?Duration"), "audition_csv")
        .when(head.rlike("^File type = \"ooTextFile"), "textgrid")
        .when(head.rlike("^@ This file written"), "avid_ds")
        .when(head.rlike("^\\d+(\\.\\d+)?\\t\\d+(\\.\\d+)?\\t"), "aud")
        .when(head.rlike("^\\[\\d+:\\d{2}\\.\\d{2,3}\\]"), "lrc")
        .when(head.rlike("(?m)^\\*\\*[^*\\n]+:?\\*\\*"), "markdown")
        .when(head.rlike("(?m)^\\[\\d+:\\d{2}\\.\\d{2,3}\\]"), "lrc")
        .when(head.rlike("(?m)\\[\\d{1,2}:\\d{2}(:\\d{2})?\\]\\s*$|^## \\["), "markdown")
        .when(head.rlike("\\d+:\\d{2}:\\d{2}[,.]\\d{1,3}\\s*-->"), "srt")
        .when(head.rlike("(?m)^\\d+:\\d{2}:\\d{2}\\.\\d{3},\\d+:\\d{2}:\\d{2}\\.\\d{3}$"), "sbv")
        .when(head.rlike("(?m)^\\d+(\\.\\d+)?\\t\\d+(\\.\\d+)?\\t"), "aud")
        .when(head.rlike("ooTextFile"), "textgrid")
        .when(head.rlike("(?m)^\\{\\d+\\}\\{\\d+\\}"), "sub")
        .when(head.rlike("(?i)<SAMI>"), "sami")
        .otherwise("txt")
    )


# Endings of paths in the order they are tried.
EXTENSIONS = (
    (".srt", "srt"), (".ass", "ass"), (".ssa", "ssa"), (".sub", "sub"), (".smi", "sami"), (".sami", "sami"), (".sbv", "sbv"), (".lrc", "lrc"), (".srv3", "srv3"), (".ytt", "srv3"),
    (".json", "json"), (".json3", "json3"), (".csv", "csv"), (".tsv", "tsv"), (".aud", "aud"), (".txt", "aud"), (".textgrid", "textgrid"), (".ttml", "ttml"), (".xml", "ttml"),
    (".fcpxml", "fcpxml"), (".fcpxmld", "fcpxml"),
)


def is_content(source: Column) -> Column:
    """A text that cannot be a path: several lines or over 500 characters."""
    return F.contains(source, F.lit("\n")) | (F.length(source) > 500)


def can_read(source: Column, content: Column, fmt: str) -> Column:
    """Whether a format's reader takes a path (with the file's content, null where unknown) or a text given in its place."""
    low, given = F.lower(source), is_content(source)
    body = F.when(given, source).otherwise(content)
    head = F.left(F.coalesce(body, F.lit("")), F.lit(4096))
    if fmt == "vtt":
        return F.when(given, F.startswith(F.trim(source), F.lit("WEBVTT"))).otherwise(F.endswith(low, F.lit(".vtt")))
    if fmt in ("markdown", "md", "gemini"):
        known = F.contains(low, F.lit("gemini")) | head.rlike("\\[\\d{1,2}:\\d{2}(?::\\d{2})?\\]|\\*\\*.+?[:：]\\*\\*")
        return ~given & F.endswith(low, F.lit(".md")) & known
    if fmt == "premiere_xml":
        return (given | F.endswith(low, F.lit(".xml"))) & F.contains(F.lower(F.left(head, F.lit(1024))), F.lit("<xmeml"))
    if fmt == "json3":
        marked = F.contains(F.left(source, F.lit(500)), F.lit('"wireMagic"')) | F.contains(F.left(source, F.lit(2000)), F.lit('"events"')) & F.contains(F.left(source, F.lit(2000)), F.lit('"tStartMs"'))
        return F.when(given | F.ltrim(source).rlike("^\\{"), marked).otherwise(F.endswith(low, F.lit(".json3")))
    if fmt == "srv3":
        marks = F.contains(source, F.lit("<timedtext")) & F.contains(source, F.lit('format="3"'))
        return F.when(given | F.contains(source, F.lit("<timedtext")) | F.contains(source, F.lit('format="3"')), marks).otherwise(low.rlike("\\.(?:srv3|ytt)$"))
    endings = [e for e, f in EXTENSIONS if f == fmt]
    found = F.lit(False)
    for e in endings:
        found = found | F.endswith(low, F.lit(e))
    return found


def detect_path(path: Column, content: Column) -> Column:
    """Format of a file by its path: those told by content first, then the ending, then an ending that is a format's name; else null."""
    low = F.lower(path)
    ending = F.regexp_extract(low, "\\.([^./]+)$", 1)
    sure = lambda fmt: F.coalesce(can_read(path, content, fmt), F.lit(False))
    found = F.when(sure("vtt"), "vtt").when(sure("markdown"), "markdown").when(sure("premiere_xml"), "premiere_xml").when(is_content(path), F.lit(None).cast("string"))
    for e, fmt in EXTENSIONS:
        found = found.when(F.endswith(low, F.lit(e)), fmt)
    return found.when(ending.isin(*READERS), ending)


def line_terminator(content: Column) -> Column:
    crlf = F.regexp_count(content, F.lit("\r\n"))
    return F.when(crlf > F.regexp_count(content, F.lit("\n")) - crlf, "\r\n").otherwise("\n")
