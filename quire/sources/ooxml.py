"""Word packages as rows: parts, paragraphs, runs, cells, notes and pictures, with the standard library only."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

ROWS = "path string, ok boolean, kind string, part string, ord int, table_id int, row int, cell int, depth int, style string, text string, span int, merge string, props map<string,string>"

#: Counts of an inventory, by pattern in the main part (fixed values).
FEATURES = {
    "paragraphs": r"<w:p\b", "tables": r"<w:tbl\b", "formulas": r"<m:oMath\b|<m:oMathPara\b", "sections": r"<w:sectPr\b", "fields": r"<w:fldChar\b|<w:instrText\b", "toc_fields": r"(?i)>\s*TOC\b",
    "tracked_changes": r"<w:(?:ins|del|moveFrom|moveTo)\b", "textboxes": r"<w:txbxContent\b|<wps:txbx\b|<v:textbox\b", "controls": r"<w:sdt\b", "landscape_sections": r"w:orient=[\"']landscape[\"']", "merged_cells": r"<w:gridSpan\b|<w:hMerge\b|<w:vMerge\b",
}


def _value(element, *path: str) -> str | None:
    for name in path:
        element = element.find(_W + name) if element is not None else None
    return element.get(_W + "val") if element is not None else None


def visible_text(element) -> str:
    """Text of the final view: deletions out, tabs and breaks kept, math and controls in place."""
    out = []
    for x in element:
        if x.tag in (_W + "del", _W + "moveFrom", _W + "pPr", _W + "rPr"):
            continue
        if x.tag in (_W + "t", _M + "t"):
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
        else:
            out.append(visible_text(x))
    return "".join(out)


def package_rows(path: str, content: bytes) -> list[dict]:
    """The rows of one package; one row with ok = False and the reason if it can't be read."""
    out: list[dict] = []

    def add(kind: str, part: str, text: str = "", **more) -> None:
        out.append({"path": path, "ok": True, "kind": kind, "part": part, "ord": len(out), "text": text, "props": {}, **more})

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names = package.namelist()
            raw = package.read("word/document.xml").decode("utf-8", "ignore")
            counts = {k: len(re.findall(p, raw)) for k, p in FEATURES.items()}
            counts |= {"images": sum(n.startswith("word/media/") for n in names), "headers": sum(bool(re.fullmatch(r"word/header\w*\.xml", n)) for n in names), "footers": sum(bool(re.fullmatch(r"word/footer\w*\.xml", n)) for n in names)}
            counts |= {"text_chars": len(re.sub(r"<[^>]+>", "", raw).strip()), "objects": sum(n.startswith("word/embeddings/") for n in names)}
            add("features", "word/document.xml", props={k: str(v) for k, v in counts.items()})
            for name in sorted(n for n in names if n.startswith("word/media/")):
                add("image", name, hashlib.sha256(package.read(name)).hexdigest()[:20])
            for note in ("footnote", "endnote"):
                if f"word/{note}s.xml" in names:
                    for x in ET.fromstring(package.read(f"word/{note}s.xml")).iter(_W + note):
                        if x.get(_W + "type") not in ("separator", "continuationSeparator", "continuationNotice"):
                            add(note, f"word/{note}s.xml", visible_text(x).strip(), style=x.get(_W + "id"))
            tables = iter(range(1 << 30))

            def walk(element, depth: int, place: dict) -> None:
                for x in element:
                    if x.tag == _W + "p":
                        props = {k: v for k, v in {"align": _value(x, "pPr", "jc"), "level": _value(x, "pPr", "outlineLvl"), "break": "1" if x.find(f".//{_W}sectPr") is not None else None}.items() if v}
                        sizes = [int(s) / 2 for r in x.iter(_W + "r") if (s := _value(r, "rPr", "sz")) and s.isdigit()]
                        if sizes:
                            props["size"] = str(max(sizes))
                        if any(r.find(f"{_W}rPr/{_W}b") is not None and _value(r, "rPr", "b") not in ("0", "false", "off") for r in x.iter(_W + "r")):
                            props["bold"] = "1"
                        add("paragraph", "word/document.xml", visible_text(x), depth=depth, style=_value(x, "pPr", "pStyle"), props=props, **place)
                    elif x.tag == _W + "tbl":
                        number = next(tables)
                        for i, row in enumerate(x.findall(_W + "tr")):
                            for j, cell in enumerate(row.findall(_W + "tc")):
                                across, down = cell.find(f"{_W}tcPr/{_W}hMerge"), cell.find(f"{_W}tcPr/{_W}vMerge")
                                merge = ["", "continue" if across is not None and across.get(_W + "val") != "restart" else "restart"][across is not None]
                                own = {"table_id": number, "row": i, "cell": j}
                                add("cell", "word/document.xml", "\n".join(visible_text(p) for p in cell.findall(_W + "p")), depth=depth, span=int(_value(cell, "tcPr", "gridSpan") or 1), merge=merge,
                                    props={} if down is None else {"vmerge": down.get(_W + "val") or "continue"}, **own)
                                walk(cell, depth + 1, own)
                    elif x.tag in (_W + "sdt", _W + "sdtContent", _W + "ins", _W + "body", _W + "smartTag", _W + "customXml"):
                        walk(x, depth, place)

            walk(ET.fromstring(raw), 0, {})
    except Exception as error:  # one bad file is one row, not a failed job
        return [{"path": path, "ok": False, "kind": "error", "part": "", "ord": 0, "text": f"bad_docx:{type(error).__name__}", "props": {}}]
    return out


def read_packages(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """All .docx files under a path as rows (ROWS). Files are read by executors; one file is held at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = [r | {"props": list(r["props"].items())} for r in package_rows(name.as_py(), content.as_py())]
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.mapInArrow(run, ROWS)


def features(rows: DataFrame) -> DataFrame:
    """path and the inventory's counts, as columns."""
    names = [*FEATURES, "images", "headers", "footers", "text_chars", "objects"]
    return rows.where("kind = 'features'").select("path", *[F.col("props")[n].cast("int").alias(n) for n in names])
