"""Paths as columns: lexical normalisation and containment.

Symbolic links can only be resolved where the files are, so these functions look at the text of a path alone.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column, cwd: str = "/", home: str = "/root") -> Column:
    """Absolute path without . and .. and doubled slashes; ~ is the given home, and a relative path starts at cwd."""
    whole = (
        F.when(path == "~", F.lit(home))
        .when(F.startswith(path, F.lit("~/")), F.concat(F.lit(home), F.substr(path, F.lit(2))))
        .when(F.startswith(path, F.lit("/")), path)
        .otherwise(F.concat(F.lit(cwd + "/"), path))
    )
    above = lambda parts: F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    step = lambda parts, p: F.when(p == "..", above(parts)).when(p.isin("", "."), parts).otherwise(F.concat(parts, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a normalised path is the root or below it, component by component. One that isn't normal is nowhere inside."""
    normal = F.startswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|\z)"))
    return normal & ((root == "/") | (path == root) | F.startswith(path, F.concat(root, F.lit("/"))))


def resolve(path: str) -> str:
    """On the driver: with symbolic links."""
    return os.path.realpath(os.path.expanduser(path))
