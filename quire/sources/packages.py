"""Word packages as a Python data source: their streams of items as rows, and rows written as packages.

    spark.dataSource.register(Packages)
    spark.read.format("packages").load(folder)
    rows.write.format("packages").mode("append").option("folders", "true").save(folder)

Reading: one partition for each run of files, filters on path and kind are pushed into the reader (where
spark.sql.python.filterPushdown.enabled is on), so files that no row is asked of aren't opened. Writing: one package for
each row, under a hidden name until the job commits; then they get their names and a manifest is written. A job that
fails leaves nothing that is read; its hidden files are deleted, but for those of tasks that were still at work then.
With the option folders, for many packages: each task fills folders of its own, so the driver renames and lists folders
and never sees their files, and a folder is a partition when it is read. A name must then be the only one in its task;
rows with one name must stand in one partition for the second to be refused.
Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

ROWS = "path string, ok boolean, paragraph int, item int, kind string, text string, ref string, boxed string, in_cell boolean"
WRITTEN = "name string, document string, relations string, media map<string,binary>"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Elements whose content counts as if they weren't there, and those whose content is gone (fixed values).
CLEAR = frozenset("customXml smartTag ins moveTo hyperlink fldSimple sdtContent".split())
GONE = frozenset("del moveFrom delText delInstrText instrText".split())
KINDS = ("text", "picture", "math", "formula", "footnote", "endnote")


class _Names(dict):
    """Local names by tag, each told once."""

    def __missing__(self, tag: str) -> str:
        if len(self) > 4096:
            self.clear()
        name = self[tag] = tag.rpartition("}")[2]
        return name


_NAMES = _Names()


def local(element) -> str:
    return _NAMES[element.tag]


def visible(element) -> str:
    """Text of the final view: deletions and text boxes out, tabs and breaks kept."""
    name = local(element)
    if name in GONE or name == "txbxContent":
        return ""
    if name in ("t", "tab", "br", "cr"):
        return {"t": element.text or "", "tab": "\t"}.get(name, "\n")
    if name == "sdt":
        return "".join(visible(x) for part in element if local(part) == "sdtContent" for x in part)
    return "".join(map(visible, element))


def stream(paragraph, notes: dict[str, dict[str, str]], targets: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(kind, text, ref) of a paragraph's items in order. Text runs up to the next item of another kind are one; blank ones
    are none. A picture's ref is its file, the first place of each counts; a note's text is that of its body."""
    out: list[tuple[str, str, str]] = []
    held: list[str] = []
    seen: set[str] = set()

    def text():
        whole = "".join(held)
        held.clear()
        if whole.strip():
            out.append(("text", whole, ""))

    def walk(parent, in_run: bool):
        for x in parent:
            name = _NAMES[x.tag]
            if name in GONE:
                continue
            if name == "r":
                walk(x, True)
            elif in_run and name in ("t", "tab", "br", "cr"):
                held.append(visible(x))
            elif name in ("oMath", "oMathPara"):
                text()
                out.append(("formula" if name == "oMathPara" else "math", "".join(t.text or "" for t in x.iter(_M + "t")), ""))
            elif in_run and name in ("drawing", "pict"):
                text()
                for part in x.iter():
                    ref = part.get(_R + "embed") or part.get(_R + "id") or ""
                    if local(part) in ("blip", "imagedata") and ref in targets and ref not in seen:
                        seen.add(ref)
                        out.append(("picture", "", targets[ref]))
            elif in_run and name in ("footnoteReference", "endnoteReference"):
                text()
                kind, ref = name[: -len("Reference")], (x.get(_W + "id") or "").strip()
                out.append((kind, notes.get(kind, {}).get(ref, ""), ref))
            elif name in CLEAR or name == "p":
                walk(x, False)
            elif name == "sdt":
                for part in x:
                    if local(part) == "sdtContent":
                        walk(part, False)

    walk(paragraph, False)
    text()
    return iter(out)


def package_rows(path: str, content: bytes) -> Iterator[tuple]:
    """The rows (ROWS) of one package; one that can't be read is one row, with ok = False and the reason as text.

    paragraph counts those outside boxes; boxed is textbox or control for the text of such a paragraph, which has rows of
    its own (item -1), in_cell tells whether a paragraph stands in a table.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names = set(package.namelist())
            read = lambda name: ET.fromstring(package.read(name)) if name in names else ()
            root = ET.fromstring(package.read("word/document.xml"))
            targets = {x.get("Id", ""): posixpath.normpath(posixpath.join("word", x.get("Target", ""))) for x in read("word/_rels/document.xml.rels")}
            notes = {kind: {x.get(_W + "id"): visible(x).strip() for x in read(f"word/{kind}s.xml") if x.get(_W + "type") not in ("separator", "continuationSeparator", "continuationNotice")} for kind in ("footnote", "endnote")}
    except Exception as error:  # one bad file is one row, not a failed job
        yield (path, False, None, None, "error", f"bad_docx:{type(error).__name__}", "", "", False)
        return
    number = -1
    todo = [(root, "", False)]
    while todo:
        element, boxed, in_cell = todo.pop()
        name = _NAMES[element.tag]
        if name in GONE:
            continue
        if name == "p" and boxed:
            yield (path, True, None, -1, "text", visible(element), "", boxed, in_cell)
        if name == "p" and boxed != "textbox":
            number += 1
            for k, (kind, text, ref) in enumerate(stream(element, notes, targets)):
                yield (path, True, number, k, kind, text, ref, "", in_cell)
        inner = "textbox" if name == "txbxContent" else boxed or ("control" if name == "sdtContent" else "")
        inside = in_cell or name == "tc"
        for x in reversed(element):
            if len(x) or _NAMES[x.tag] == "p":  # others have no rows
                todo.append((x, inner, inside))


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root


#: What the files and folders of a job that hasn't committed are called, and files of it below such a folder.
_HIDDEN = re.compile(r"/\.[^/]*$|/\.[0-9a-f]{32}-[^/]*/")


def _packages(system, root: str, recursive: bool = True) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, recursive=recursive))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".docx") and not _HIDDEN.search(f.path[len(root.rstrip("/")) :]))


def _batches(rows: Iterator[tuple]):
    """Rows (ROWS) as Arrow batches of bounded size."""
    import pyarrow as pa

    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, ROWS.split(", "))])
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[5])
        if len(held) == 2000 or size > 1 << 22:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


@dataclass
class Files(InputPartition):
    paths: list[str]
    folder: str = ""


class PackageReader(DataSourceReader):
    #: Files of a partition: at least, and at most where there are so many that all partitions would be larger.
    AT_ONCE, MOST, PARTS = 64, 2048, 256

    def __init__(self, path: str):
        self.path, self.paths, self.kinds = path, None, None

    def pushFilters(self, filters):
        """Takes equality on path and kind; the rest is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("path",), ("kind",)):
                yield f
            elif f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                self.kinds = values if self.kinds is None else self.kinds & values

    def partitions(self):
        from pyarrow import fs

        system, root = _files(self.path)
        top = system.get_file_info(fs.FileSelector(root))
        listed = set()
        for f in top:
            if f.is_file and re.fullmatch(r"folders-[0-9a-f]{32}\.json", f.base_name):
                with system.open_input_stream(f.path) as content:
                    listed |= set(json.loads(content.read())["folders"])
        folders = [f.path for f in top if not f.is_file and f.base_name in listed]
        names = _packages(system, root, recursive=False)
        for f in top:
            if not f.is_file and f.base_name not in listed and not _HIDDEN.search("/" + f.base_name + "/"):
                names += _packages(system, f.path)
        names = sorted(n for n in names if self.paths is None or n in self.paths)
        folders = sorted(f for f in folders if self.paths is None or any(posixpath.dirname(p) == f for p in self.paths))
        step = min(max(self.AT_ONCE, len(names) // self.PARTS), self.MOST)
        return [Files([], f) for f in folders] + [Files(names[i : i + step]) for i in range(0, len(names), step)] or [Files([])]

    def read(self, partition):
        return _batches(self._rows(partition))

    def _rows(self, partition):
        system, _ = _files(self.path)
        paths = partition.paths
        if partition.folder:
            paths = [n for n in _packages(system, partition.folder) if self.paths is None or n in self.paths]
        for name in paths:
            with system.open_input_stream(name) as f:
                content = f.read()
            for row in package_rows(name, content):
                if self.kinds is None or row[4] in self.kinds:
                    yield row


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _packed(row) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", row.document)
        if row.relations:
            package.writestr("word/_rels/document.xml.rels", row.relations)
        for part, content in (row.media or {}).items():
            package.writestr(part, bytes(content))
    return buffer.getvalue()


def _delete(system, path: str, is_file: bool) -> None:
    (system.delete_file if is_file else system.delete_dir)(path)


class PackageWriter(DataSourceWriter):
    #: Packages of a folder.
    IN_FOLDER = 2048

    def __init__(self, path: str, overwrite: bool, folders: bool = False):
        if overwrite:
            raise ValueError("packages are appended; write into a new folder")
        self.path, self.job, self.folders = path, uuid.uuid4().hex, folders

    def write(self, iterator):
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        made = []
        try:
            (self._fill if self.folders else self._write)(system, root, iterator, made)
        except BaseException:
            for hidden, _ in made:
                _delete(system, hidden, not self.folders)
            raise
        return Written(made)

    def _write(self, system, root, iterator, made) -> None:
        for row in iterator:
            hidden, name = f"{root}/.{self.job}-{uuid.uuid4().hex}", f"{root}/{row.name}.docx"
            with system.open_output_stream(hidden) as out:
                out.write(_packed(row))
            made.append((hidden, name))

    def _fill(self, system, root, iterator, made) -> None:
        seen = set()
        for n, row in enumerate(iterator):
            if row.name in seen:
                raise ValueError("two rows have one name")
            seen.add(row.name)
            if n % self.IN_FOLDER == 0:
                name = f"{self.job}-{uuid.uuid4().hex}"
                system.create_dir(f"{root}/.{name}")
                made.append((f"{root}/.{name}", f"{root}/{name}"))
            with system.open_output_stream(f"{made[-1][0]}/{row.name}.docx") as out:
                out.write(_packed(row))

    def commit(self, messages):
        system, root = _files(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        names = sorted(name for _, name in files)
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("two rows have one name")
        for hidden, name in files:
            system.move(hidden, name)
        self._clear()
        system.create_dir(root, recursive=True)
        kind, manifest = ("folders", "folders") if self.folders else ("files", "manifest")
        with system.open_output_stream(f"{root}/{manifest}-{self.job}.json") as out:
            out.write(json.dumps({kind: [posixpath.basename(n) for n in names]}).encode())

    def abort(self, messages):
        self._clear()

    def _clear(self):
        """What attempts of this job have left, also those of tasks that were lost."""
        from pyarrow import fs

        system, root = _files(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(f.path).startswith(f".{self.job}-"):
                _delete(system, f.path, f.is_file)


class Packages(DataSource):
    @classmethod
    def name(cls):
        return "packages"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return PackageReader(self.options["path"])

    def writer(self, schema, overwrite):
        return PackageWriter(self.options["path"], overwrite, self.options.get("folders", "false").lower() == "true")


def registered(spark):
    """The session with this source, and with filters pushed into it."""
    spark.dataSource.register(Packages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
