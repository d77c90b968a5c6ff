"""Settings: from defaults, an env file and the environment, in rising order of precedence. Nothing is read at import."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

# The suffixes of each type of file.
DOCUMENTS = (".pdf", ".txt", ".md", ".docx", ".doc", ".html", ".htm", ".epub", ".odt")
PICTURES = (".jpg", ".jpeg", ".bmp", ".png", ".heic", ".tiff", ".tif")
VIDEOS = (".mov", ".vob", ".mkv", ".avi", ".mp4", ".mcf")


def suffix_list(text: str) -> tuple[str, ...]:
    """The entries of a comma-separated list without surrounding blanks; empty entries are left out."""
    return tuple(s for s in (part.strip() for part in text.split(",")) if s)


@dataclass(frozen=True)
class Config:
    """datadir: where tables are kept. docroot: the root of the file tree. The others: suffixes of each type of file, in lower case."""

    datadir: str = "."
    docroot: str = "/data/files/"
    docsuf: tuple[str, ...] = field(default=DOCUMENTS)
    picsuf: tuple[str, ...] = field(default=PICTURES)
    vidsuf: tuple[str, ...] = field(default=VIDEOS)

    @classmethod
    def from_env_file(cls, envfile: str = "config.env", override: bool = False, **given) -> Config:
        """Settings IND_DATADIR, IND_DOCROOT, IND_DOCSUF, IND_PICSUF and IND_VIDSUF of the environment and, where it has none (or with
        override even then), of the env file; then those given. A missing file is an empty one.
        """
        written: dict[str, str] = {}
        path = Path(envfile)
        if path.is_file():
            for line in path.read_text(encoding="utf-8").splitlines():
                name, equals, value = line.partition("=")
                if equals and not name.lstrip().startswith("#"):
                    value = value.strip()
                    value = value[1:].split(value[0])[0] if value[:1] in ("'", '"') else value.split(" #")[0].split("\t#")[0].strip()
                    written[name.strip().removeprefix("export ").strip()] = value
        found: dict = {}
        for f in fields(cls):
            key = f"IND_{f.name.upper()}"
            value = written.get(key, os.environ.get(key)) if override else os.environ.get(key, written.get(key))
            if value:
                found[f.name] = suffix_list(value) if f.name.endswith("suf") else value
        return cls(**(found | given))

    def get_ftype(self, suffix: str | None) -> str | None:
        """doc, pic, vid or None for a suffix in any case; the first list that has it wins."""
        low = (suffix or "").lower()
        return next((name for name, known in (("doc", self.docsuf), ("pic", self.picsuf), ("vid", self.vidsuf)) if low in known), None)
