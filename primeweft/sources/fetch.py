"""Choosing, sizing and fetching a subset of assemblies."""

from __future__ import annotations

import hashlib
import os
import pathlib
import shutil
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The samples of the default subset; GB of a haplotype as downloaded and with its
# indexes, of the backbone, and of memory that a run needs and leaves free.
DEFAULT_SAMPLES = ("HG01884", "HG00097", "HG00408")
DOWNLOAD_GB, INDEXED_GB, BACKBONE_GB, PEAK_GB, SPARE_GB = 1.0, 0.91, 8.5, 12.0, 3.0


def default_subset(records: DataFrame) -> DataFrame:
    """The first haplotype of the default samples."""
    return records.where(F.col("sample_id").isin(*DEFAULT_SAMPLES) & (F.col("haplotype") == 1)).orderBy("sample_id")


def footprint(n_haplotypes: Column) -> tuple[Column, Column]:
    """GB to download, and GB on disk once indexed, of so many haplotypes."""
    return n_haplotypes * F.lit(DOWNLOAD_GB), F.bround(n_haplotypes * F.lit(INDEXED_GB), 6)


@dataclass(frozen=True)
class Resources:
    """What a subset needs against what this host has."""

    haplotypes: int
    free_disk_gb: float
    memory_gb: float | None  # None: not known

    @property
    def download_gb(self) -> float:
        return self.haplotypes * DOWNLOAD_GB

    @property
    def indexed_gb(self) -> float:
        return self.haplotypes * INDEXED_GB

    @property
    def disk_ok(self) -> bool:
        return self.indexed_gb + BACKBONE_GB <= self.free_disk_gb

    @property
    def memory_ok(self) -> bool:
        return self.memory_gb is None or self.memory_gb >= PEAK_GB + SPARE_GB

    @property
    def risky(self) -> bool:
        return not (self.disk_ok and self.memory_ok)


def resources(haplotypes: int, folder: str) -> Resources:
    """The host's free disk below the nearest folder that exists, and its memory."""
    at = next(p for p in (pathlib.Path(folder).absolute(), *pathlib.Path(folder).absolute().parents) if p.exists())
    try:
        memory = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 1e9
    except (ValueError, OSError):
        memory = None
    return Resources(haplotypes, shutil.disk_usage(at).free / 1e9, memory)


def md5_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def _get(url: str, path: pathlib.Path) -> None:
    """The file appears as a whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)
    part.replace(path)


def download(url: str, md5_url: str, index_url: str | None, path: str) -> bool:
    """Fetches an assembly and its index; False if a valid one is there already.

    The published sum decides: a file that doesn't have it is deleted, and raises.
    """
    with urllib.request.urlopen(md5_url) as f:
        wanted = f.read().decode().split()[0]
    out = pathlib.Path(path)
    fresh = not (out.exists() and md5_of(path) == wanted)
    if fresh:
        _get(url, out)
        if (got := md5_of(path)) != wanted:
            out.unlink()
            raise ValueError(f"{path} has the md5 {got}, not {wanted}")
    if index_url:
        _get(index_url, out.with_name(out.name + ".fai"))
    return fresh
