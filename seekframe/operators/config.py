"""Which files belong to the index (inventory Q21-Q28, Q30)."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excluded_name(name: Column, filters: Iterable[str]) -> Column:
    """Exact names by a set, all ``*suffix`` filters by one expression, other patterns by another."""
    filters = list(filters)
    exact = [f for f in filters if not re.search(r"[*?\[]", f)]
    suffixes = [re.escape(f[1:]) for f in filters if f.startswith("*") and not re.search(r"[*?\[]", f[1:])]
    globs = [fnmatch.translate(f) for f in filters if f not in exact and not (f.startswith("*") and not re.search(r"[*?\[]", f[1:]))]
    out = name.isin(exact) if exact else F.lit(False)
    if suffixes:
        out = out | name.rlike(f"({'|'.join(suffixes)})$")
    for g in globs:
        out = out | name.rlike("^" + g.replace(r"\Z", "$").replace(r"\z", "$"))
    return out


def normalised_folders(folders: dict[str, bool]) -> list[tuple[str, bool]]:
    """Folders with a slash at the end, the longest first; those that repeat what the folder above says are dropped, and so are excludes with nothing above."""
    entries = sorted(((f if f.endswith("/") else f + "/", included) for f, included in folders.items()), key=lambda e: len(e[0]))
    kept: list[tuple[str, bool]] = []
    for path, included in entries:
        above = next((i for p, i in reversed(kept) if path.startswith(p)), False)
        if included != above:
            kept.append((path, included))
    return sorted(kept, key=lambda e: (-len(e[0]), e[0]))


def included(path: Column, folders: dict[str, bool], filters: Iterable[str] = (), hidden: bool = False) -> Column:
    """The longest folder that holds the path decides, names on the way down from it must not be excluded; a listed folder itself ignores filters."""
    filters = list(filters)
    whole = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    out = F.lit(False)
    for folder, yes in reversed(normalised_folders(folders)):
        parts = F.filter(F.split(F.substring(whole, len(folder) + 1, 1 << 20), "/"), lambda p: p != "")
        bad = F.exists(parts, lambda p: excluded_name(p, filters) | (F.lit(not hidden) & p.startswith(".")))
        out = F.when(whole.startswith(folder), F.lit(yes) & ((whole == folder) | ~bad)).otherwise(out)
    return out


def mime_included(mime: Column, excluded: Iterable[str]) -> Column:
    return ~mime.isin(list(excluded))


def can_be_searched(folder: str, folders: dict[str, bool]) -> bool:
    """Whether the folder is in the index or an included folder lies below it."""
    own = folder if folder.endswith("/") else folder + "/"
    entries = normalised_folders(folders)
    deciding = next((yes for p, yes in entries if own.startswith(p)), False)
    return deciding or any(yes and p.startswith(own) for p, yes in entries)


def usable(files: DataFrame, mounts: DataFrame, explicit: Iterable[str] = ()) -> DataFrame:
    """Files (device) of mounts (device, removable, network, optical, accessible, mount_path) that may be indexed; explicitly included mount paths always."""
    bad = (F.col("removable") | F.col("network") | F.col("optical") | ~F.col("accessible")) & ~F.col("mount_path").isin(list(explicit) or [""])
    return files.join(mounts.where(bad).select("device"), "device", "left_anti")


def sanitize(files: DataFrame, mounts: DataFrame, devices: Iterable[int] = (), url: str | None = None, ignore: Iterable[str] = ()) -> DataFrame:
    """Files (device, path, available) by device (positive: only, negative: not), unanchored URL pattern, and availability."""
    only, never = [d for d in devices if d > 0], [-d for d in devices if d < 0]
    out = files.where(F.col("device").isin(only)) if only else files
    out = out.where(~F.col("device").isin(never)) if never else out
    out = out.where(F.col("path").rlike(url)) if url else out
    for what in ignore:
        if what in ("available", "unavailable"):
            out = out.where(~F.col("available") if what == "available" else F.col("available"))
        else:
            out = out.join(mounts.select("device"), "device", "left_anti" if what == "mounted" else "left_semi")
    return out
