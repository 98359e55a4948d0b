"""Path guards and the gate of read-only use."""

from __future__ import annotations

import os
import unicodedata
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import extension


class GuardError(ValueError):
    """A path outside what an operation may touch."""


def check_relative(path: str, roots: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None) -> str:
    """The path decoded once and composed, if it is relative, without ``..``, under one of the roots and of an allowed
    extension (without dot, any case)."""
    if not path:
        raise GuardError("empty path")
    clean = unicodedata.normalize("NFC", unquote(path, errors="strict") if "%" in path else path)
    if clean.startswith("/"):
        raise GuardError("absolute path")
    if ".." in clean.split("/"):
        raise GuardError("path leaves the vault")
    if roots and not any(clean.startswith(r.rstrip("/") + "/") for r in roots):
        raise GuardError("path lies outside its folder")
    if extensions is not None and os.path.splitext(clean)[1][1:].lower() not in extensions:
        raise GuardError("extension not allowed")
    return clean


def resolve(root: str, path: str, roots: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None) -> str:
    """The absolute place of a guarded path; symbolic links may not lead out of the root."""
    clean = check_relative(path, roots, extensions)
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, clean))
    if full != base and not full.startswith(base + os.sep):
        raise GuardError("path leaves the vault")
    return full


def path_problem(path: Column, roots: list[str], extensions: list[str] | None = None) -> Column:
    """The same check for a column of plain paths (no symbolic links): the first problem, or null."""
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    inside = F.lit(not roots)
    for r in roots:
        inside = inside | decoded.startswith(r.rstrip("/") + "/")
    out = F.when(path.isNull() | (path == ""), "empty").when(decoded.startswith("/"), "absolute").when(F.array_contains(F.split(decoded, "/"), ".."), "traversal").when(~inside, "outside")
    return out if extensions is None else out.when(~F.lower(extension(decoded)).isin(extensions), "extension")


#: The operations of the audit log and whether each writes.
OPERATIONS = {"READ": False, "LIST": False, "SEARCH": False, "METADATA": False, "HISTORY": False, "RESOURCE": False, "CREATE": True, "UPDATE": True, "MOVE": True, "DELETE": True}


def allowed(operation: str, read_only: bool) -> bool:
    return not (read_only and OPERATIONS[operation.upper()])


def audit_line(ts: Column, operation: Column, path: Column, details: Column) -> Column:
    """A line of the audit log: time, operation padded to ten characters, path, details."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.concat_ws(" | ", stamp, F.rpad(operation, 10, " "), path, details), F.lit("\n"))
