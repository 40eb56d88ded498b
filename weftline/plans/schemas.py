"""Saved mapping schemas with their history, as JSON files: save, list, go back, and try a candidate first."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from weftline.operators.mapping import Schema, load_schema


class SchemaStore:
    """One folder: `name.json` in use, `name.N.json` before it, `name.candidate.json` on trial."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _file(self, name: str, tag: str = "") -> Path:
        return self.folder / f"{name}{tag}.json"

    def current(self, name: str) -> dict[str, Any] | None:
        """The schema in use."""
        file = self._file(name)
        return json.loads(file.read_text()) if file.exists() else None

    def history(self, name: str) -> list[int]:
        """Revisions kept, oldest first."""
        tags = (f.name[len(name) + 1 : -5] for f in self.folder.glob(f"{name}.*.json"))
        return sorted(int(t) for t in tags if t.isdigit())

    def save(self, body: dict[str, Any]) -> Schema:
        """Puts a checked schema to use; the one before joins the history under its revision."""
        schema = load_schema(body)
        old = self.current(schema.name)
        if old is not None:
            self._file(schema.name, f".{old.get('revision', 0)}").write_text(json.dumps(old, ensure_ascii=False))
        self._file(schema.name).write_text(json.dumps(body, ensure_ascii=False))
        return schema

    def rollback(self, name: str) -> Schema:
        """Puts the last revision of the history back to use."""
        revisions = self.history(name)
        if not revisions:
            raise ValueError(f"{name} has no earlier revision")
        file = self._file(name, f".{revisions[-1]}")
        body = json.loads(file.read_text())
        self._file(name).write_text(json.dumps(body, ensure_ascii=False))
        file.unlink()
        return load_schema(body)

    def propose(self, body: dict[str, Any]) -> Schema:
        """Keeps a candidate beside the schema in use."""
        schema = load_schema(body)
        self._file(schema.name, ".candidate").write_text(json.dumps(body, ensure_ascii=False))
        return schema

    def accept(self, name: str) -> Schema:
        """Puts the candidate to use."""
        file = self._file(name, ".candidate")
        schema = self.save(json.loads(file.read_text()))
        file.unlink()
        return schema
