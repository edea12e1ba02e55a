"""Properties in a watched JSON or YAML file: flat keys, re-read when the file changes."""

from __future__ import annotations

import json
import logging
import os
from typing import Any

from tasklathe.config import BY_NAME, DEFINITIONS, DynamicProperty

log = logging.getLogger(__name__)


def _scalar(text: str) -> Any:
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("["):
        inner = text[1:-1].strip()
        return [str(_scalar(x)) for x in inner.split(",")] if inner else []
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    try:
        return int(text)
    except ValueError:
        return text


def parse_flat_yaml(text: str) -> dict[str, Any]:
    """The part of YAML that a flat file of scalars and lists of strings needs; anything nested is an error."""
    out: dict[str, Any] = {}
    key = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip() or line == "---":
            continue
        if line.lstrip().startswith("- "):
            if key is None:
                raise ValueError(f"line {n}: item without a key")
            if out[key] is None:
                out[key] = []
            out[key].append(str(_scalar(line.lstrip()[2:])))
            continue
        if line[0] == " " or ":" not in line:
            raise ValueError(f"line {n}: not a flat key")
        key, _, value = line.partition(":")
        key = key.strip().strip("\"'")
        out[key] = _scalar(value)
    return out


def dump(values: dict[str, Any], path: str) -> str:
    if path.endswith((".yaml", ".yml")):
        return "".join(f"{k}: {json.dumps(list(v) if isinstance(v, tuple) else v)}\n" for k, v in values.items())
    return json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in values.items()}, indent=2) + "\n"


class SettingsFile:
    """A supplier of properties from a file. ``poll`` re-reads it if it changed (call it once per micro-batch)."""

    def __init__(self, path: str, prefix: str = ""):
        self.path, self.prefix = path, prefix
        self._stamp: tuple[int, int] | None = None
        self.properties: dict[str, DynamicProperty] = {}
        self.poll()

    def _read(self) -> dict[str, Any]:
        with open(self.path, encoding="utf-8") as f:
            text = f.read()
        got = parse_flat_yaml(text) if self.path.endswith((".yaml", ".yml")) else json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("not an object")
        return got

    def poll(self) -> bool:
        """True if something changed. A bad value is logged and the old one kept; null means the default; other names are ignored."""
        s = os.stat(self.path)
        if self._stamp == (s.st_mtime_ns, s.st_size):
            return False
        try:
            got = self._read()
        except (OSError, ValueError) as e:
            if self._stamp is None:
                raise
            log.warning("%s can't be read, settings stay: %s", self.path, e)
            return False
        self._stamp = (s.st_mtime_ns, s.st_size)
        changed = False
        for name, v in got.items():
            name = name.removeprefix(self.prefix)
            d = BY_NAME.get(name)
            if d is None:
                continue
            p = self.properties.get(name)
            try:
                if p is None:
                    self.properties[name] = DynamicProperty(d, v)
                    changed = True
                else:
                    changed = p.set(d.default if v is None else v) is not None or changed
            except ValueError as e:
                if p is None:
                    raise
                log.warning("%s", e)
        return changed

    def supplier(self) -> dict[str, DynamicProperty]:
        return dict(self.properties)

    @staticmethod
    def register(path: str, prefix: str = "") -> SettingsFile:
        """Open the file, first writing one with the defaults if there is none; of several writers one wins."""
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(dump({prefix + d.name: d.default for d in DEFINITIONS}, path))
        except FileExistsError:
            pass
        return SettingsFile(path, prefix)
