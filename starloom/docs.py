"""Model documentation from specs: an entity diagram and a bus matrix, spliced into files between markers."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from starloom.spec import Spec


def diagram(specs: Mapping[str, Spec]) -> str:
    """A Mermaid ER diagram of gold tables and their relationships."""
    gold = [s for s in specs.values() if s.layer == "gold"]
    lines = ["erDiagram"]
    for s in gold:
        keys = {*s.business_key, *(r.column for r in s.relationships)}
        lines.append(f"  {s.entity} {{")
        lines += [f"    {a.type.replace('(', '_').replace(',', '_').replace(')', '')} {a.name}" for a in s.attributes if a.name in keys or a.name.endswith("_sk")]
        lines.append("  }")
    for s in gold:
        lines += [f"  {specs[r.to].entity} ||--o{{ {s.entity} : {r.column}" for r in s.relationships]
    return "\n".join(lines)


def bus_matrix(specs: Mapping[str, Spec]) -> str:
    """A Markdown table of facts against dimensions, and every gold table's grain."""
    dims = [s for s in specs.values() if s.kind == "dimension"]
    facts = [s for s in specs.values() if s.kind == "fact"]
    head = ["| fact | " + " | ".join(d.entity for d in dims) + " |", "|---" * (len(dims) + 1) + "|"]
    rows = ["| " + " | ".join([f.entity, *("x" if any(r.to == d.name for r in f.relationships) else "" for d in dims)]) + " |" for f in facts]
    grains = [f"- **{s.entity}**: {s.grain}" for s in [*dims, *facts]]
    return "\n".join([*head, *rows, "", *grains])


def spliced(text: str, name: str, body: str) -> str:
    """``text`` with ``body`` between the markers of ``name``; an error if they are not both there, once."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(begin) > text.index(end):
        raise ValueError(f"markers of {name} are missing or repeated")
    return text[: text.index(begin) + len(begin)] + f"\n{body}\n" + text[text.index(end) :]


def refresh(path: str | Path, specs: Mapping[str, Spec], check: bool = False) -> bool:
    """Bring a file's generated parts up to date; with ``check`` only say whether they are."""
    path = Path(path)
    old = path.read_text(encoding="utf-8")
    new = spliced(spliced(old, "diagram", f"```mermaid\n{diagram(specs)}\n```"), "bus-matrix", bus_matrix(specs))
    if new != old and not check:
        path.write_text(new, encoding="utf-8")
    return new == old
