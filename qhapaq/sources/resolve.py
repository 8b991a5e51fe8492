"""Finding source files: present, cached, newest of a listing, or downloaded. Runs on the driver, before Spark reads."""

from __future__ import annotations

import json
import re
import shutil
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import TypeVar

R = TypeVar("R")
#: Files that belong to a shapefile.
SIBLINGS = (".dbf", ".shx", ".prj", ".cpg", ".sbn", ".sbx")


@dataclass(frozen=True)
class Source:
    """local: where the file is wanted. cache: a copy elsewhere. url with pattern: a page to look for dated files on."""

    name: str
    local: Path
    cache: Path | None = None
    url: str | None = None
    pattern: str | None = None
    manual: bool = False


def retried(do: Callable[[], R], times: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> R:
    """do, again after a failure of input or output, with growing waits; the last failure is raised."""
    for k in range(times):
        try:
            return do()
        except OSError:
            if k + 1 == times:
                raise
            sleep(wait * 2**k)
    raise ValueError("times must be 1 or more")


def newest(listing: str, pattern: str) -> str | None:
    """The file name on a page that has the latest day-month-year date; of equals the last name."""
    def day(name: str) -> tuple[str, str]:
        m = re.search(r"(\d{2})-(\d{2})-(\d{4})", name)
        return (f"{m[3]}{m[2]}{m[1]}" if m else "", name)

    return max(set(re.findall(pattern, listing)), key=day, default=None)


def download(url: str, to: Path, opener: Callable = urllib.request.urlopen, chunk: int = 1 << 20) -> None:
    """Stream into a .part file and rename, so that a broken download is never taken for a whole one."""
    part = to.with_name(to.name + ".part")
    to.parent.mkdir(parents=True, exist_ok=True)
    with opener(url) as response, part.open("wb") as out:
        shutil.copyfileobj(response, out, chunk)
    part.replace(to)


def log_entry(path: Path, name: str, entry: dict) -> None:
    """Put an entry into a JSON log by name; an unreadable log starts anew."""
    try:
        log = json.loads(path.read_text(encoding="utf-8"))
        log = log if isinstance(log, dict) else {}
    except (OSError, ValueError):
        log = {}
    log[name] = entry | {"fecha": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(log, ensure_ascii=False, indent=2), encoding="utf-8")


def _copied(cache: Path, local: Path) -> None:
    local.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(cache, local)
    if cache.suffix == ".shp":
        for s in SIBLINGS:
            if cache.with_suffix(s).exists():
                shutil.copy2(cache.with_suffix(s), local.with_suffix(s))


def resolve(source: Source, log: Path, opener: Callable = urllib.request.urlopen) -> str:
    """How the file was got: existente, cache, descargado or manual (not there, and must be fetched by hand)."""
    try:
        if source.local.exists() and source.local.stat().st_size:
            how = "existente"
        elif source.cache and source.cache.exists():
            _copied(source.cache, source.local)
            how = "cache"
        elif source.url and not source.manual:
            url = source.url
            if source.pattern:
                name = newest(retried(lambda: opener(source.url).read()).decode("utf-8", "replace"), source.pattern)
                if name is None:
                    raise FileNotFoundError(f"no file like {source.pattern} at {source.url}")
                url = f"{source.url.rsplit('/', 1)[0]}/{name}" if "://" not in name else name
            retried(lambda: download(url, source.local, opener))
            how = "descargado"
        else:
            how = "manual"
    except OSError as e:
        log_entry(log, source.name, {"resultado": "error", "detalle": str(e)})
        raise
    log_entry(log, source.name, {"resultado": how, "archivo": str(source.local)})
    return how
