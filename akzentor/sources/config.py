"""Run configuration, cache state and assets; all on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path

STATE_VERSION = 3


@dataclass
class Library:
    name: str
    description: str = ""
    extra: dict = field(default_factory=dict)


@dataclass
class Config:
    libraries: list[Library] = field(default_factory=list)
    output_dir: str = "results"
    cache_dir: str = ".cache"
    adapters_dir: str = "adapters"
    dubious_file: str | None = None
    assets_dir: str = "assets"
    reports: list[str] = field(default_factory=lambda: ["ru", "en"])

    @classmethod
    def read(cls, path: str) -> Config:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and k != "libraries"}
        return cls(libraries=[Library(x["name"], x.get("description", ""), x.get("extra", {})) for x in raw.get("libraries", [])], **known)

    def write(self, path: str, force: bool = False) -> None:
        if Path(path).exists() and not force:
            raise FileExistsError(path)
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")

    def select(self, names: list[str]) -> list[Library]:
        return [x for x in self.libraries if not names or x.name in names]

    def digest(self) -> str:
        """Of the whole configuration, whatever part of it runs."""
        return text_digest(json.dumps(asdict(self), ensure_ascii=False, sort_keys=True))


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass
class Entry:
    library_name: str
    gold_hash: str
    config_hash: str
    completed_at: str
    output_file: str
    result_hash: str


class Cache:
    """Which libraries' results still hold: those of the same gold text and configuration whose
    file is there."""

    def __init__(self, folder: str) -> None:
        self.path, self.entries = Path(folder) / "state.json", {}
        if self.path.exists():
            raw = json.loads(self.path.read_text(encoding="utf-8"))
            if raw.get("version") == STATE_VERSION:
                self.entries = {k: Entry(**v) for k, v in raw.get("entries", {}).items()}

    def status(self, name: str, gold: str, config: str) -> str:
        e = self.entries.get(name)
        if e is None:
            return "NOT RUN"
        if e.gold_hash != gold:
            return "STALE (gold)"
        if e.config_hash != config:
            return "STALE (config)"
        there, _, path = e.output_file.rpartition("://")  # other file systems are looked at when they are read
        return "VALID" if there not in ("", "file") or Path(path).exists() else "MISSING FILE"

    def put(self, name: str, gold: str, config: str, output: str, result: str) -> None:
        self.entries[name] = Entry(name, gold, config, datetime.now().isoformat(), output, result)
        self._save()

    def drop(self, name: str | None = None) -> None:
        """One library's entry, or all."""
        self.entries = {} if name is None else {k: v for k, v in self.entries.items() if k != name}
        self._save()

    def orphans(self, names: list[str]) -> list[str]:
        return sorted(set(self.entries) - set(names))

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"version": STATE_VERSION, "entries": {k: asdict(v) for k, v in self.entries.items()}}, ensure_ascii=False, indent=2), encoding="utf-8")


#: What an assets folder must hold: the engine's dictionary, forms, tails and morphology.
ASSETS = ("vec_words.pq", "oov_forms.pq", "oov_tails.pq", "morph.pq")


def missing_assets(folder: str, names: tuple[str, ...] = ASSETS) -> list[str]:
    """Assets aren't downloaded here; this tells which ones a folder lacks."""
    return [n for n in names if not (Path(folder) / n).exists()]
