"""Docbases and their indexes, from Python or from an XML file."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from ..functions.keys import key_type

FORMATS = ("XML",)


@dataclass(frozen=True)
class IndexDef:
    name: str
    type: str
    path: str
    unique: bool = False

    def __post_init__(self) -> None:
        key_type(self.type)


@dataclass
class DocBaseDef:
    name: str
    directory: str
    capacity: int = 30_000
    format: str = "XML"
    data: str = ""
    indexes: dict[str, IndexDef] = field(default_factory=dict)

    def index(self, name: str) -> IndexDef:
        if name not in self.indexes:
            raise KeyError(f"docbase {self.name} has no index {name}; it has {sorted(self.indexes)}")
        return self.indexes[name]


@dataclass
class Catalog:
    bases: dict[str, DocBaseDef] = field(default_factory=dict)

    def by_name(self, name: str) -> DocBaseDef:
        if name not in self.bases:
            raise KeyError(f"no docbase {name}; there are {sorted(self.bases)}")
        return self.bases[name]

    def by_directory(self, path: str) -> DocBaseDef:
        """The docbase whose documents lie in a folder."""
        for base in self.bases.values():
            if base.directory.rstrip("/") == path.rstrip("/"):
                return base
        raise KeyError(f"no docbase keeps documents in {path}")

    def route(self, files: list[str]) -> dict[str, list[str]]:
        """Files by docbase, from their folders; paths are absolute."""
        out: dict[str, list[str]] = {}
        for f in files:
            folder, _, name = f.rpartition("/")
            if not f.startswith("/") and "://" not in f:
                raise ValueError(f"{f} is not an absolute path")
            out.setdefault(self.by_directory(folder).name, []).append(f)
        return out

    def links(self) -> dict[str, list[str]]:
        """Index names that several docbases have: the ways from one to another."""
        found: dict[str, list[str]] = {}
        for base in self.bases.values():
            for name in base.indexes:
                found.setdefault(name, []).append(base.name)
        return {k: v for k, v in sorted(found.items()) if len(v) > 1}


def load_catalog(source: str) -> Catalog:
    """From a file's path or its text: ``documents`` elements (``name format dir capacity``) with
    ``indexes`` (``directory``) of ``index`` (``name type unique``) each with a ``key`` path.  An
    index without a key is left out."""
    root = ET.fromstring(source) if source.lstrip().startswith("<") else ET.parse(source).getroot()
    catalog = Catalog()
    for d in root.iter("documents"):
        kind = d.get("format", "XML").upper()
        if kind not in FORMATS:
            raise ValueError(f"unknown document format {kind}")
        base = DocBaseDef(d.get("name", ""), d.get("dir", ""), int(d.get("capacity", "30000")), kind)
        for group in d.iter("indexes"):
            base.data = group.get("directory", "")
            for i in group.iter("index"):
                path = i.findtext("key")
                if path:
                    base.indexes[i.get("name", "")] = IndexDef(i.get("name", ""), i.get("type", ""), path.strip(), i.get("unique", "").lower() in ("1", "yes", "true"))
        catalog.bases[base.name] = base
    return catalog
