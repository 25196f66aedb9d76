"""Random draws as pure column expressions.

A draw depends only on ``(seed, parts…)`` through md5, so it is the same under any
partitioning, retry or executor loss, and can be repeated in plain SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def uniform(*parts) -> Column:
    """Uniform number in (0, 1) from the md5 of the joined parts."""
    text = F.concat_ws(":", *[_as_text(p) for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Standard normal number by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "a")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "b"))


def index_draw(n: Column, *parts) -> Column:
    """1-based index drawn with replacement from ``1..n``."""
    return (F.floor(uniform(*parts) * n) + F.lit(1)).cast("long")


def hashed(lead: bytes, parts: Sequence[bytes]) -> np.ndarray:
    """Inside a helper: :func:`uniform` of text that is ``lead`` and each of ``parts``."""
    ends = np.frombuffer(b"".join([md5(lead + p).digest() for p in parts]), dtype=">u4")[::4]
    return (ends.astype(float) + 0.5) / 4294967296.0
