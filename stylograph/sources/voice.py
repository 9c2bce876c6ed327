"""Voice files: a style guide and exemplar texts in one small JSON file."""

from __future__ import annotations

import json
from pathlib import Path


def write_voice(path: str, style_guide: str, exemplars: list[str]) -> None:
    Path(path).write_text(json.dumps({"style_guide": style_guide, "exemplars": exemplars}, indent=2), encoding="utf-8")


def read_voice(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
