"""Settings with ``${NAME:default}`` places, merged from several sources."""

from __future__ import annotations

import json
import os
import re
from typing import Any

_PLACE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def interpolate(value: Any, env: dict[str, str] | None = None) -> Any:
    """``value`` with every place filled from the environment, however deep it stands: places are filled in its JSON text."""
    known = {k: json.dumps(v)[1:-1] for k, v in (os.environ if env is None else env).items()}
    return json.loads(_PLACE.sub(lambda m: known.get(m[1], m[2] or ""), json.dumps(value, ensure_ascii=False)))


def load(*paths: str, env: dict[str, str] | None = None) -> dict:
    """JSON, or YAML where a reader is installed; later files replace top-level keys of earlier ones."""
    out: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            out |= yaml.safe_load(text) or {}
        else:
            out |= json.loads(text)
    return interpolate(out, env)
