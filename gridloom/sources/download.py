"""Files from the network, kept once they are there. These run on the driver, before Spark reads the files."""

from __future__ import annotations

import shutil
import time
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

TRIES, WAIT_S = 3, 5.0


def fetch(url: str, path: Path, tries: int = TRIES, wait: Callable[[float], None] = time.sleep, opened: Callable = urllib.request.urlopen) -> Path:
    """Stream a file to path, at most `tries` times, with a longer wait after each failure. What is half there is not left under its name."""
    part = path.with_name(path.name + ".part")
    path.parent.mkdir(parents=True, exist_ok=True)
    for k in range(1, tries + 1):
        try:
            with opened(url) as source, part.open("wb") as out:
                shutil.copyfileobj(source, out)
            return part.replace(path)
        except OSError:
            part.unlink(missing_ok=True)
            if k == tries:
                raise
            wait(WAIT_S * k)
    raise ValueError("no try was asked for")


def cached(url: str, folder: Path, suffixes: tuple[str, ...] = (".dbf",), **options) -> list[Path]:
    """The files of a zip archive with these endings, in folder, under the archive's name; fetched only if one is missing."""
    name = url.rsplit("/", 1)[-1].removesuffix(".zip")
    wanted = [folder / (name + x) for x in suffixes]
    if not all(x.exists() for x in wanted):
        archive = fetch(url, folder / f"{name}.zip", **options)
        with zipfile.ZipFile(archive) as z:
            for suffix, path in zip(suffixes, wanted, strict=True):
                inside = [x for x in z.namelist() if x.lower().endswith(suffix)]
                if len(inside) != 1:
                    raise ValueError(f"{url} holds {len(inside)} files ending in {suffix}")
                with z.open(inside[0]) as source, path.open("wb") as out:
                    shutil.copyfileobj(source, out)
        archive.unlink()
    return wanted
