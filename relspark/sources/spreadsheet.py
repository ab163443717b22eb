"""Spreadsheets as populations: relation blocks and interface sheets of .xlsx files, or the same rows from anywhere.

A block starts with a cell ``[name]``. Its first row names a relation for each column after the first (``~``
at the end: the pair is swapped), the second row the concepts, with an optional delimiter after the concept
(``Part;`` splits the cells of the column at semicolons); data rows follow until the next block. A first cell ``_NEW``
makes an atom of the file, sheet and row.
"""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

from ..interfaces import Box
from ..script import Script

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass(frozen=True)
class Sheet:
    name: str
    rows: list[list]  # cells: str, float, bool or None


class CellError(ValueError):
    pass


def read_xlsx(path: str) -> list[Sheet]:
    """All sheets of a workbook, by the standard library alone; an error cell is refused."""
    with zipfile.ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in tree("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for s in tree("xl/workbook.xml").find("m:sheets", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            sheet = tree(target if target.startswith("xl/") else f"xl/{target}")
            rows: list[list] = []
            for row in sheet.iter(f"{{{_NS['m']}}}row"):
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - len(rows))]
                for cell in row.findall("m:c", _NS):
                    column = _column(cell.get("r") or "") if cell.get("r") else len(rows[-1])
                    rows[-1] += [None] * (column - len(rows[-1]))
                    rows[-1].append(_cell(cell, strings))
            out.append(Sheet(s.get("name"), rows))
        return out


def _column(place: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", place)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _cell(cell, strings: list[str]):
    kind, value = cell.get("t", "n"), cell.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
    if value is None or value.text is None:
        return None
    if kind == "e":
        raise CellError(f"cell {cell.get('r')} holds the error {value.text}")
    return strings[int(value.text)] if kind == "s" else value.text == "1" if kind == "b" else value.text if kind == "str" else float(value.text)


def _plain(cell) -> str | None:
    """A cell as text: trimmed, numbers without a trailing .0, nothing if empty."""
    if cell is None:
        return None
    if isinstance(cell, bool):
        return "TRUE" if cell else "FALSE"
    if isinstance(cell, float):
        return str(int(cell)) if cell.is_integer() and abs(cell) < 1e15 else repr(cell)
    return cell.strip() or None


def blocks(sheet: Sheet, file: str = "sheet") -> Script:
    """The relations and pairs of a sheet's blocks, as a script part."""
    script, heads = Script(), None
    for number, row in enumerate(sheet.rows, 1):
        first = _plain(row[0]) if row else None
        if first and re.fullmatch(r"\[.*\]", first):
            heads = [_plain(c) for c in row]
            concepts = None
        elif heads and concepts is None:
            concepts = [_concept(_plain(c)) for c in row]
            script.concepts.add(concepts[0][0])
        elif heads and first:
            key = f"_NEW_{file}_{sheet.name}_{number}" if first == "_NEW" else first
            keys = [k.strip() for k in key.split(concepts[0][1]) if k.strip()] if concepts[0][1] else [key]
            script.atoms.append((concepts[0][0], keys))
            for head, (concept, delimiter), cell in zip(heads[1:], concepts[1:], row[1:], strict=False):
                text = _plain(cell)
                if not head or not concept or text is None:
                    continue
                text = f"_NEW_{file}_{sheet.name}_{number}" if text == "_NEW" else text
                values = [v.strip() for v in text.split(delimiter) if v.strip()] if delimiter else [text]
                name, swap = head.rstrip("~"), head.endswith("~")
                src, tgt = (concept, concepts[0][0]) if swap else (concepts[0][0], concept)
                script.relations.setdefault((name, src, tgt), [])
                script.pairs.append(((name, src, tgt), [(v, k) if swap else (k, v) for k in keys for v in values]))
    return script


def _concept(text: str | None) -> tuple[str | None, str | None]:
    m = re.fullmatch(r"(\w[\w.]*)\s*(\W)?", text or "")
    return (m[1], m[2]) if m else (None, None)


def interface_pairs(sheet: Sheet, boxes: list[Box], script: Script) -> Script:
    """A sheet named like an interface: its columns are the fields that are plain (or swapped) relations."""
    from ..terms import Converse, Rel

    box = next((b for b in boxes if b.label == sheet.name), None)
    if box is None or not sheet.rows:
        return script
    fields = {f.label: f.term for f in box.fields}
    for row in sheet.rows[1:]:
        key = _plain(row[0]) if row else None
        for label, cell in zip(sheet.rows[0][1:], row[1:], strict=False):
            term, value = fields.get(_plain(label)), _plain(cell)
            swap = isinstance(term, Converse)
            rel = term.of if swap else term
            if key and value and isinstance(rel, Rel):
                script.pairs.append(((rel.name, rel.src, rel.tgt), [(value, key) if swap else (key, value)]))
    return script
