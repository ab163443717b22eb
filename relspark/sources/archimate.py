"""ArchiMate exchange of the Archi tool: folders, elements, relationships, properties and views as relations.

Every element is an atom of the concept of its type; a relationship is an atom too, with ``source`` and ``target``,
and a pair of the relation that its type names; ``folder`` says where things lie, ``inside`` which element a view shows in
which, ``inView`` which view shows what.
"""

from __future__ import annotations

from xml.etree import ElementTree

from ..script import Script

_TYPE = "{http://www.w3.org/2001/XMLSchema-instance}type"


def read_archimate(text: str) -> Script:
    script, root = Script(), ElementTree.fromstring(text)
    kind = {e.get("id"): (e.get(_TYPE) or "").split(":")[-1] for e in root.iter("element") if e.get("id")}
    script.name = root.get("name") or "Archi"

    def add(name: str, src: str, tgt: str, pair: tuple[str, str], *props: str) -> None:
        known = script.relations.setdefault((name, src, tgt), [])
        known += [p for p in props if p not in known]
        script.pairs.append(((name, src, tgt), [pair]))

    def walk(node, folder: str | None) -> None:
        for part in node:
            tag = part.tag.split("}")[-1]
            if tag == "folder":
                if folder:
                    add("folder", "Folder", "Folder", (part.get("id"), folder), "UNI")
                if part.get("name"):
                    add("name", "Folder", "Text", (part.get("id"), part.get("name")), "UNI")
                walk(part, part.get("id"))
            elif tag == "element":
                element(part, folder)

    def element(e, folder: str | None) -> None:
        own, of = e.get("id"), kind[e.get("id")]
        script.concepts.add(of)
        script.atoms.append((of, [own]))
        if e.get("name"):
            add("name", of, "Text", (own, e.get("name")), "UNI")
        if folder:
            add("folder", of, "Folder", (own, folder), "UNI")
        a, b = e.get("source"), e.get("target")
        if a in kind and b in kind:
            add("source", of, kind[a], (own, a), "UNI")
            add("target", of, kind[b], (own, b), "UNI")
            add(of.removesuffix("Relationship")[:1].lower() + of.removesuffix("Relationship")[1:], kind[a], kind[b], (a, b))
        for k, p in enumerate(e.iter("property")):
            name = f"{own}_property_{k}"
            add("property", of, "Property", (own, name), "INJ")
            add("key", "Property", "Text", (name, p.get("key") or ""), "UNI")
            add("value", "Property", "Text", (name, p.get("value") or ""), "UNI")
        for child in e.findall("child"):
            shown(child, own, of, None)

    def shown(child, view: str, of: str, around: str | None) -> None:
        own = child.get("archimateElement")
        if own in kind:
            add("inView", kind[own], of, (own, view))
            if around:
                add("inside", kind[own], kind[around], (own, around))
        for inner in child.findall("child"):
            shown(inner, view, of, own if own in kind else around)

    walk(root, None)
    return script
