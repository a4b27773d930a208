"""Readers: the parts (pages, sheets, segments, …) of files. Libraries that aren't installed make a warning, never a failure.

Every reader maps (path, content) to parts: kind, key, title, text, props, and warnings. read_parts() runs them in one Arrow pass; the plain text and
HTML path stays in Spark expressions (see plans.build).
"""

from __future__ import annotations

import csv
import io
import json
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.chunking import fold_windows

# Sizes that are read of a delimited file and of a sheet; lengths of metadata; Exif tags.
MAX_TEXT, SNIFF, MAX_ROWS, META = 5 << 20, 8192, 50_000, 300
EXIF = {271: "make", 272: "camera_model", 305: "software", 306: "modified", 315: "artist", 33432: "copyright", 36867: "taken", 33434: "exposure", 33437: "f_number", 34855: "iso", 37386: "focal_length"}
PARTS = "path string, kind string, key string, title string, text string, props string, warnings string"

Part = dict
#: What a transcriber and an OCR are: functions of (path, content), which run in the workers.
Transcriber = Callable[[str, bytes], tuple[str | None, list[tuple[float, float, str]]]]
Ocr = Callable[[str, bytes], str]


def part(kind: str, key: object, text: str = "", title: str | None = None, **props: object) -> Part:
    return {"kind": kind, "key": str(key), "title": title, "text": text, "props": {k: v for k, v in props.items() if v is not None}}


def read_delimited(path: str, content: bytes) -> list[Part]:
    """One sheet of a CSV, TSV or PSV file; cells stripped, empty rows dropped, one row a line of text with tab-separated cells."""
    text = content[:MAX_TEXT].decode("utf-8-sig", "replace")
    ext = path.rsplit(".", 1)[-1].lower()
    sep = {"tsv": "\t", "psv": "|"}.get(ext)
    if sep is None:
        try:
            sep = csv.Sniffer().sniff(text[:SNIFF], ",;\t|").delimiter
        except csv.Error:
            sep = ","
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=sep)]
    rows = [r for r in rows if any(r)]
    return [part("sheet", "Sheet1", json.dumps(rows, ensure_ascii=False), rows=len(rows))]


def _cell(v: object) -> str:
    return "" if v is None else v.isoformat() if isinstance(v, (date, datetime)) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v).strip()


def read_excel(path: str, content: bytes) -> list[Part]:
    import openpyxl

    book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
    out = []
    for sheet in book.worksheets:
        rows = []
        for row in sheet.iter_rows(values_only=True):
            cells = [_cell(v) for v in row]
            while cells and not cells[-1]:
                cells.pop()
            if cells:
                rows.append(cells)
            if len(rows) >= MAX_ROWS:
                break
        out.append(part("sheet", sheet.title, json.dumps(rows, ensure_ascii=False), rows=len(rows)))
    return out


def _bookmarks(pdf) -> dict[int, str]:
    """The first bookmark of each page, by page number."""
    out: dict[int, str] = {}
    todo = list(reversed(pdf.outline or []))
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            todo += reversed(item)
            continue
        try:
            at, label = pdf.get_destination_page_number(item) + 1, str(item.title).strip()
        except Exception:  # a bookmark that leads nowhere
            continue
        if label:
            out.setdefault(at, label[:200])
    return out


def read_pdf(path: str, content: bytes) -> list[Part]:
    """Pages from 1 on, headed by their first bookmark; blank ones are left out and keep their number. Metadata as part 'document'."""
    import pypdf

    pdf = pypdf.PdfReader(io.BytesIO(content))
    if pdf.is_encrypted and not pdf.decrypt(""):
        raise ValueError("password-protected PDF")
    named = {"/Title": "title", "/Author": "author", "/Subject": "subject", "/Producer": "producer", "/CreationDate": "created"}
    meta = {named[k]: str(v).strip()[:META] for k, v in (pdf.metadata or {}).items() if k in named and str(v or "").strip()}
    out, bad = [], []
    try:
        marks = _bookmarks(pdf)
    except Exception:
        marks = {}
    for i, page in enumerate(pdf.pages, 1):
        try:
            text = page.extract_text() or ""
        except Exception as e:
            bad.append(f"page {i}: {e}")
            continue
        if text.strip():
            out.append(part("page", i, text, page=i, chars=len(text.strip()), heading=marks.get(i)))
    return [part("document", "", title=meta.pop("title", None), pages=len(pdf.pages), encrypted=True if pdf.is_encrypted else None, warnings=bad or None, **meta), *out]


def _level(style: str) -> int:
    """Level of the heading that a Word style makes; 0 for running text. An unnumbered one is of level 1."""
    if style in ("title", "subtitle"):
        return 1
    if not style.startswith("heading"):
        return 0
    n = style.removeprefix("heading").strip()
    return min(int(n), 6) if n.isdigit() else 1


def read_docx(path: str, content: bytes) -> list[Part]:
    import docx

    doc = docx.Document(io.BytesIO(content))
    lines = []
    for p in doc.paragraphs:
        level = _level(((p.style.name if p.style is not None else "") or "").lower())
        if p.text.strip():
            lines.append(("#" * level + " " if level else "") + p.text)
    for i, t in enumerate(doc.tables, 1):
        rows = [" | ".join(c.text.strip().replace("\n", " ") for c in r.cells) for r in t.rows]
        lines += [f"[table {i}]", *[r for r in rows if r.strip(" |")]]
    core = doc.core_properties
    props = {k: str(getattr(core, k))[:200] for k in ("author", "subject", "keywords", "last_modified_by", "category", "created", "modified") if getattr(core, k, None)}
    return [part("document", "", "\n".join(lines), title=core.title or None, paragraphs=len(doc.paragraphs), tables=len(doc.tables), **props)]


def read_pptx(path: str, content: bytes) -> list[Part]:
    """Slides from 1 on; the title is the heading and isn't repeated in the text. Slides with neither title, text nor notes are left out."""
    import pptx

    slides = list(pptx.Presentation(io.BytesIO(content)).slides)
    out = [part("document", "", slides=len(slides))]
    for i, slide in enumerate(slides, 1):
        title = (slide.shapes.title.text or "").strip() if slide.shapes.title is not None else ""
        texts = [(s.text_frame.text or "").strip() for s in slide.shapes if s.has_text_frame]
        lines = [t for t in texts if t and t != title]
        notes = slide.notes_slide.notes_text_frame.text.strip() if slide.has_notes_slide else ""
        if notes:
            lines += ["[speaker notes]", notes]
        if title or lines:
            out.append(part("page", i, "\n".join(lines), title=title or None, page=i, slide=i, has_notes=str(bool(notes)).lower(), heading=title or None))
    return out


def degrees(dms: tuple, ref: str) -> float:
    """Degrees, minutes, seconds with a letter of the compass as signed degrees."""
    d, m, s = (float(x) for x in dms)
    v = d + m / 60 + s / 3600
    return round(-v if ref in ("S", "W") else v, 6)


def read_image(path: str, content: bytes) -> list[Part]:
    from PIL import Image

    img = Image.open(io.BytesIO(content))
    w, h = img.size
    exif = img.getexif()
    props = {EXIF[k]: str(v)[:200] for k, v in exif.items() if k in EXIF}
    gps = exif.get_ifd(0x8825)
    # The names of the metadata are the reader's; documents.caption() knows them.
    if 2 in gps and 4 in gps:
        props |= {"lat": degrees(gps[2], gps.get(1, "N")), "lon": degrees(gps[4], gps.get(3, "E"))}
    return [part("document", "", width=w, height=h, format=img.format, mode=img.mode, megapixels=round(w * h / 1e6, 2), **props)]


def read_media(path: str, content: bytes) -> list[Part]:
    """Duration, bit rate, tags and codecs by ffprobe."""
    with tempfile.NamedTemporaryFile(suffix="." + path.rsplit(".", 1)[-1]) as f:
        f.write(content)
        f.flush()
        got = subprocess.run(["ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", f.name], capture_output=True, timeout=120, check=True).stdout
    info = json.loads(got)
    fmt = info.get("format", {})
    seen = next(((s.get("width"), s.get("height")) for s in info.get("streams", []) if s.get("width")), (None, None))
    tags = {k.lower(): str(v)[:META] for k, v in (fmt.get("tags") or {}).items()}
    return [part("document", "", title=tags.get("title"), duration=float(fmt.get("duration") or 0), bitrate=int(fmt.get("bit_rate") or 0), codecs=",".join(s.get("codec_name", "") for s in info.get("streams", [])), width=seen[0], height=seen[1], **tags)]


def keyframe_times(duration: float, n: int) -> list[float]:
    """Times of n evenly spread frames, each in the middle of its share."""
    return [duration * (i + 0.5) / n for i in range(n)]


def clock(seconds: float) -> str:
    """H:MM:SS, or M:SS under an hour."""
    m, s = divmod(int(seconds), 60)
    return f"{m // 60}:{m % 60:02d}:{s:02d}" if m >= 60 else f"{m}:{s:02d}"


def transcript(path: str, content: bytes, transcribe: Transcriber, duration: float, keyframes: int) -> tuple[list[Part], dict]:
    """Segments of what a transcriber heard, frames of a video's keyframe times, and props of the document. The transcriber gives (language, [(start, end, text), ...])."""
    language, heard = transcribe(path, content)
    out: list[Part] = []
    for a, b, text in fold_windows(heard):
        out.append(part("segment", len(out), text, start_time=round(a, 2), end_time=round(b, 2), timestamp=clock(a), ord=len(out)))
    props = {"language": language, "transcript_chars": len(" ".join(p["text"] for p in out))}
    if out and keyframes and duration > 0:
        out += [part("frame", i, time=round(t, 2), timestamp=clock(t)) for i, t in enumerate(keyframe_times(duration, keyframes))]
    return out, props


READ: dict[str, Callable[[str, bytes], list[Part]]] = {"pdf": read_pdf, "docx": read_docx, "slides": read_pptx, "image": read_image, "audio": read_media, "video": read_media}


def register(name: str, fn: Callable[[str, bytes], list[Part]]) -> None:
    """Add or replace a reader; give it to workers by calling read_parts() after it."""
    READ[name] = fn


def read_file(reader: str, path: str, content: bytes, table: dict | None = None, transcribe: Transcriber | None = None, ocr: Ocr | None = None, keyframes: int = 0) -> tuple[list[Part], list[str]]:
    """Parts and warnings of one file; never raises. A failing transcriber or OCR costs its text, not the file."""
    parts, notes = _read(reader, path, content, table)
    doc = next((p for p in parts if p["kind"] == "document"), None)
    if reader in ("audio", "video"):
        if transcribe is None:
            return parts, [*notes, "no transcript: no transcriber was given"]
        try:
            more, props = transcript(path, content, transcribe, float(doc["props"].get("duration") or 0) if doc else 0.0, keyframes if reader == "video" else 0)
        except Exception as e:
            return parts, [*notes, f"no transcript: {type(e).__name__}: {str(e)[:200]}"]
        doc = doc or part("document", "")
        doc["props"] |= {k: v for k, v in props.items() if v is not None}
        return [doc, *[p for p in parts if p is not doc], *more], notes if more else [*notes, "no speech detected"]
    if reader == "image" and ocr is not None:
        try:
            text = (ocr(path, content) or "").strip()
        except Exception:  # the image stays with its metadata
            text = ""
        if text:
            doc = doc or part("document", "")
            doc["text"] = text
            doc["props"]["ocr_chars"] = len(text)
            return [doc, *[p for p in parts if p is not doc]], notes
    return parts, notes


def _read(reader: str, path: str, content: bytes, table: dict | None = None) -> tuple[list[Part], list[str]]:
    fn = read_excel if reader == "sheet" and path.lower().endswith((".xlsx", ".xlsm")) else read_delimited if reader == "sheet" else (table or READ).get(reader)
    if fn is None:
        return [], [f"no reader for {reader}"]
    try:
        parts = fn(path, content)
        notes = [w for p in parts for w in p["props"].pop("warnings", None) or []]
        if reader == "pdf" and not any(p["kind"] == "page" for p in parts):
            notes.append("no extractable text")
        return parts, notes
    except ImportError as e:
        return [], [f"missing library: {e.name}"]
    except FileNotFoundError as e:
        return [], [f"missing program: {e.filename}"]
    except Exception as e:
        return [], [f"unreadable: {type(e).__name__}: {str(e)[:200]}"]


def read_parts(files: DataFrame, transcribe: Transcriber | None = None, ocr: Ocr | None = None, keyframes: int = 0) -> DataFrame:
    """PARTS of files (path, reader, content). A file without parts gives one row of kind 'document' with its warnings, so that no file is lost."""
    table = dict(READ)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, reader, content in zip(pdf["path"], pdf["reader"], pdf["content"]):
                parts, notes = read_file(reader or "none", path, bytes(content or b""), table, transcribe, ocr, keyframes)
                if not any(p["kind"] == "document" for p in parts):
                    parts = [part("document", ""), *parts]
                for n, p in enumerate(p for p in parts if p["kind"] == "sheet"):
                    p["props"]["at"] = n
                for p in parts:
                    doc = p["kind"] == "document"
                    out.append((path, p["kind"], p["key"], p["title"], p["text"], json.dumps(p["props"], ensure_ascii=False, default=str, sort_keys=True), json.dumps(notes, ensure_ascii=False) if doc and notes else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.select("path", "reader", "content").mapInPandas(run, PARTS)
