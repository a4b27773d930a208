"""Files as rows: listing, filters, digests, dispatch by extension, magic bytes."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import qualified

#: Bytes of files that one task opens, about, and that it holds before it hands them on.
TASK_BYTES, HELD_BYTES = 128 << 20, 32 << 20

# What listings leave out, size limits, extensions by reader in order of dispatch, extensions that are never text.
IGNORED_DIRS = "node_modules __pycache__ venv env dist build target vendor site-packages bower_components coverage htmlcov".split()
IGNORED_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini", ".localized"]
MAX_FILE, MAX_TEXT_FILE = 200 << 20, 1_000_000
READERS = {
    "pdf": ".pdf", "sheet": ".xlsx .xlsm .csv .tsv .psv", "docx": ".docx", "slides": ".pptx",
    "image": ".jpg .jpeg .png .gif .bmp .tiff .tif .webp", "audio": ".mp3 .wav .m4a .flac .ogg .aac", "video": ".mp4 .mov .mkv .webm .avi .m4v",
    "text": ".txt .text .md .mdx .markdown .rst .adoc .org .tex .json .jsonl .ndjson .yaml .yml .toml .ini .cfg .conf .env .properties .html .htm .xhtml .xml .svg .py .pyi .js .jsx .ts .tsx .mjs .cjs .go .rs .java .kt .kts .scala .rb .php .c .h .cc .cpp .hpp .cs .swift .m .mm .sh .bash .zsh .fish .ps1 .bat .sql .graphql .proto .tf .hcl .lua .pl .r .jl .dart .vue .svelte .ex .exs .gradle .cmake .mk .dockerfile .gitignore .editorconfig",
}
MODALITY = {"docx": "text"}
BINARY = ".png .jpg .jpeg .gif .bmp .ico .webp .tif .tiff .svgz .heic .avif .mp3 .wav .flac .ogg .m4a .aac .mp4 .mov .avi .mkv .webm .wmv .zip .tar .gz .bz2 .xz .7z .rar .jar .war .whl .egg .dmg .iso .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .so .dylib .dll .exe .bin .o .a .obj .class .pyc .pyo .wasm .db .sqlite .sqlite3 .mdb .parquet .avro .pkl .npy .npz .h5 .pt .pth .safetensors .ttf .otf .woff .woff2 .eot .lock".split()
# Fixed values: (offset in bytes, signature in hex, format), more special ones first; extensions that each format may have; formats that can't be read.
SIGNATURES = [
    (0, "255044462D", "pdf"), (0, "D0CF11E0A1B11AE1", "ole2"), (0, "7B5C727466", "rtf"), (0, "FFD8FF", "jpeg"), (0, "89504E470D0A1A0A", "png"), (0, "474946383761", "gif"),
    (0, "474946383961", "gif"), (0, "424D", "bmp"), (0, "49492A00", "tiff"), (0, "4D4D002A", "tiff"), (0, "494433", "mp3"), (0, "FFFB", "mp3"), (0, "4F676753", "ogg"),
    (0, "664C6143", "flac"), (0, "1A45DFA3", "matroska"), (4, "66747970", "mp4"), (0, "1F8B", "gzip"), (0, "425A68", "bzip2"), (0, "377ABCAF271C", "7z"), (0, "52617221", "rar"),
    (0, "7F454C46", "elf"), (0, "53514C69746520666F726D6174203300", "sqlite"), (0, "504B0304", "zip"),
]
EXPECTED = {
    "pdf": ".pdf", "ole2": ".doc .xls .ppt .msg .db", "zip": ".zip .docx .xlsx .pptx .docm .xlsm .pptm .odt .ods .odp .jar .epub .apk", "rtf": ".rtf .doc", "jpeg": ".jpg .jpeg .jpe",
    "png": ".png", "gif": ".gif", "tiff": ".tif .tiff", "bmp": ".bmp", "mp3": ".mp3", "ogg": ".ogg .oga .ogv .opus", "flac": ".flac", "matroska": ".mkv .webm", "mp4": ".mp4 .m4a .m4v .mov .3gp",
}
UNREADABLE = {"ole2": "a legacy Office file; convert it to the current format", "rtf": "an RTF document, which isn't parsed", "7z": "a 7-Zip archive", "rar": "a RAR archive", "elf": "a compiled binary"}


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; '' if there is none. A leading dot is no extension."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "[^.](\\.[^.]+)$", 1))


def _kept_dir(name: str) -> bool:
    return name not in IGNORED_DIRS and not name.startswith(".")


def _kept_file(name: str) -> bool:
    return name not in IGNORED_NAMES and not name.startswith("._")


def _entries(at: str, base: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(names of folders, (name, mtime in microseconds, size) of files) of one folder without what listings leave out; links are neither. base: scheme and authority, '' for local."""
    dirs: list[str] = []
    found: list[tuple[str, int, int]] = []
    if not base:
        try:
            with os.scandir(at) as it:
                for e in it:
                    if e.is_symlink():
                        continue
                    if e.is_dir():
                        dirs += [e.name] if _kept_dir(e.name) else []
                    elif e.is_file() and _kept_file(e.name):
                        s = e.stat()
                        found.append((e.name, s.st_mtime_ns // 1000, s.st_size))
        except OSError:  # gone, or not ours to read
            pass
        return dirs, found
    from pyarrow import fs

    for i in fs.FileSystem.from_uri(base + "/")[0].get_file_info(fs.FileSelector(at, recursive=False)):
        if i.type == fs.FileType.Directory and _kept_dir(i.base_name):
            dirs.append(i.base_name)
        elif i.type == fs.FileType.File and _kept_file(i.base_name):
            found.append((i.base_name, (i.mtime_ns or 0) // 1000, i.size))
    return dirs, found


def listing(spark: SparkSession, root: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """(path, file, mtime, size, skipped) of the files under root, without their content. path is relative, file is what contents() opens; skipped says why a file is left out, else null.

    Hidden and dependency folders, system files and links are not listed; names are taken as they are, whatever signs they have. The driver goes down the folders only until there are
    enough to share out (64 a core, or all); their files and everything below are listed in tasks. A name that isn't UTF-8 is listed with its bad bytes replaced, as skipped.
    """
    scheme, authority, at = qualified(spark, root)
    base = "" if scheme == "file" else f"{scheme}://{authority}"
    if not base and not os.path.isdir(at):
        raise NotADirectoryError(at) if os.path.exists(at) else FileNotFoundError(at)
    at = at.rstrip("/")
    enough = 64 * spark.sparkContext.defaultParallelism
    alone, below = [], [""]  # folders whose own files are to be listed, and folders to be walked
    while below and len(alone) + len(below) < enough:
        alone += below
        below = [f"{d}{n}/" for d in below for n in _entries(f"{at}/{d}", base)[0]]
    work = spark.createDataFrame([(os.fsencode(d), False) for d in alone] + [(os.fsencode(d), True) for d in below], "dir binary, deep boolean")
    work = work.repartition(max(1, min(len(alone) + len(below), enough // 16)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            todo = [(os.fsdecode(bytes(d)), deep) for d, deep in zip(pdf["dir"], pdf["deep"])]
            while todo:
                d, deep = todo.pop()
                dirs, found = _entries(f"{at}/{d}", base)
                todo += [(f"{d}{n}/", True) for n in dirs] if deep else []
                for name, mtime, size in found:
                    rel = d + name
                    shown = os.fsencode(rel).decode("utf-8", "replace")
                    rows.append((shown, f"{base}{at}/{shown}", mtime, size, "name isn't UTF-8" if shown != rel else "too large" if size > max_bytes else None))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=_LISTED)
                    rows = []
            yield pd.DataFrame(rows, columns=_LISTED)

    found = work.mapInPandas(walk, "path string, file string, mtime long, size long, skipped string")
    return found.withColumn("mtime", F.timestamp_micros("mtime"))


_LISTED = ["path", "file", "mtime", "size", "skipped"]


def tracked_paths(root: str) -> list[str] | None:
    """Paths that git tracks or doesn't ignore under root; null without git. Runs on the driver."""
    if not shutil.which("git"):
        return None
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, timeout=60, check=True).stdout
    except (subprocess.SubprocessError, OSError):
        return None
    return [p for p in out.decode(errors="replace").split("\0") if p and not os.path.islink(os.path.join(root, p))]


def text_listing(spark: SparkSession, root: str) -> DataFrame:
    """The listing for the text index: what git would commit, if root is a repository; else the plain listing."""
    files = listing(spark, root)
    scheme, _, at = qualified(spark, root)
    kept = tracked_paths(at) if scheme == "file" else None
    return files if kept is None else files.join(spark.createDataFrame([(p,) for p in kept], "path string"), "path", "left_semi")


def indexable(path: Column, size: Column) -> Column:
    """Whether a file may be text, by name and size."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~suffix(path).isin(BINARY) & ~name.isin([".DS_Store", ".gitattributes", ".gitmodules"]) & (size <= MAX_TEXT_FILE)


def contents(files: DataFrame) -> DataFrame:
    """files (with file, size) with their content, in tasks of about TASK_BYTES. Each file is opened once, by its name as it is; one that has gone, or can't be read, gives no row."""
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    times = [f.name for f in files.schema if f.dataType.simpleString() == "timestamp"]  # as numbers in Python, where local times can be ambiguous
    flat = files.withColumns({c: F.unix_micros(c) for c in times})
    schema = T.StructType([*flat.schema.fields, T.StructField("content", T.BinaryType())])
    at = flat.columns.index("file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, held = [], 0
            for row in pdf.itertuples(index=False, name=None):
                data = _open(row[at])
                if data is None:
                    continue
                got.append((*row, data))
                held += len(data)
                if held > HELD_BYTES:
                    yield pd.DataFrame(got, columns=schema.names)
                    got, held = [], 0
            yield pd.DataFrame(got, columns=schema.names)

    return flat.repartition(int(tasks), F.xxhash64("file")).mapInPandas(read, schema).withColumns({c: F.timestamp_micros(c) for c in times})


def _open(name: str) -> bytes | None:
    if name.startswith("/"):
        try:
            with open(name, "rb") as f:
                return f.read()
        except OSError:
            return None
    from pyarrow import fs

    base = "/".join(name.split("/", 3)[:3])
    try:
        with fs.FileSystem.from_uri(base + "/")[0].open_input_stream(name[len(base) :]) as f:
            return f.read()
    except OSError:
        return None


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1; null for binary content."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(~F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*00"), F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def reader(path: Column) -> Column:
    """The reader that a path is given to: by extension, in order; files without one are text; null for all others."""
    ext = suffix(path)
    c = None
    for name, exts in READERS.items():
        test = ext.isin(exts.split()) | ((ext == "") if name == "text" else F.lit(False))
        c = F.when(test, name) if c is None else c.when(test, name)
    return c


def modality(path: Column) -> Column:
    r = reader(path)
    return F.coalesce(F.when(r == "docx", "text").otherwise(r), F.lit("unknown"))


def sniffed(content: Column) -> Column:
    """Format by magic bytes, null if none matches."""
    h = F.hex(F.substring(content, 1, 32))
    c = None
    for at, sig, name in SIGNATURES:
        test = F.substring(h, 2 * at + 1, len(sig)) == sig
        c = F.when(test, name) if c is None else c.when(test, name)
    return c


def mislabelled(path: Column, fmt: Column) -> Column:
    """A note if a file's format doesn't go with its extension, else null."""
    ext = suffix(path)
    c = None
    for name, exts in EXPECTED.items():
        test = (fmt == name) & (ext != "") & ~ext.isin(exts.split())
        c = F.when(test, name) if c is None else c.when(test, name)
    return F.when(c.isNotNull(), F.concat(F.lit("content is "), c, F.lit(", not "), ext))


def explained(fmt: Column) -> Column:
    """Why a format can't be read, null if it can."""
    c = None
    for name, why in UNREADABLE.items():
        c = F.when(fmt == name, why) if c is None else c.when(fmt == name, why)
    return c


def capabilities() -> dict[str, bool]:
    """Which optional libraries and programs are at hand."""
    have = lambda m: importlib.util.find_spec(m) is not None
    return {"pdf": have("pypdf"), "excel": have("openpyxl"), "docx": have("docx"), "pptx": have("pptx"), "image": have("PIL"), "transcription": have("faster_whisper"), **{p: shutil.which(p) is not None for p in ("ffprobe", "ffmpeg", "tesseract", "git")}}


def missing_extras() -> list[str]:
    return sorted(k for k, v in capabilities().items() if not v)
