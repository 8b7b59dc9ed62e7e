"""Field mappings: which targets and types there are, what is wrong with a mapping, and mapping files."""

from __future__ import annotations

# The fields of an article that a mapping may fill; anything under EXTRA is free.
TARGETS = ("ID", "Title", "Subtitle", "Content", "Author", "Description", "Language", "URL", "PublishedAt", "CreatedAt", "Metadata.SourceId", "Metadata.SourceName", "Metadata.Category", "Metadata.ImportedAt")
RENAMED = {"Metadata.PublishedAt": "PublishedAt"}
EXTRA = "Metadata.Extra."
KINDS = ("string", "int", "float", "bool", "date", "datetime", "uuid", "url")


def mapping_faults(rows: list[dict]) -> list[str]:
    """What is wrong with a mapping; an empty list if nothing is."""
    if not rows:
        return ["there are no field mappings"]
    out = []
    for i, r in enumerate(rows):
        target = r.get("target_field") or ""
        if not r.get("source_field"):
            out.append(f"row {i}: no source field")
        if r.get("source_type", "string") not in KINDS:
            out.append(f"row {i}: unknown type {r.get('source_type')!r}")
        if target in RENAMED:
            out.append(f"row {i}: {target} is now {RENAMED[target]}")
        elif not target or target == EXTRA or target not in TARGETS and not target.startswith(EXTRA):
            out.append(f"row {i}: unknown target {target!r}")
    return out


def mapping_of(raw: dict, fmt: str = "csv") -> list[dict]:
    """Mapping rows of a configuration: kind, version, a name and the dataset must be there, and the rows without fault; ValueError names all that is wrong."""
    out = [f"no {k}" for k in ("kind", "version", "dataset") if not raw.get(k)]
    if not (raw.get("metadata") or {}).get("name"):
        out.append("no name")
    rows = [
        {"dataset": raw.get("dataset"), "fmt": fmt, "pos": i, "source_field": r.get("source"), "source_type": r.get("sourceType") or "string", "target_field": r.get("target"), "required": bool(r.get("required"))}
        for i, r in enumerate(raw.get("fieldMappings") or [], 1)
    ]
    out += mapping_faults(rows)
    if out:
        raise ValueError("; ".join(out))
    return rows
