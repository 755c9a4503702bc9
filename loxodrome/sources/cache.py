"""Least-recently-used cache of persisted DataFrames, keyed by a digest of plan options."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict

from pyspark.sql import DataFrame

from loxodrome.errors import GeoError


def digest(key) -> str:
    """SHA-256 of a key's canonical JSON."""
    return hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()


class FrameCache:
    def __init__(self, bound: int = 20) -> None:
        self.bound, self.frames, self.hits, self.misses = bound, OrderedDict(), 0, 0

    def get(self, key) -> DataFrame | None:
        k = digest(key)
        if k in self.frames:
            self.frames.move_to_end(k)
            self.hits += 1
            return self.frames[k]
        self.misses += 1
        return None

    def put(self, key, df: DataFrame) -> DataFrame:
        k = digest(key)
        self.frames[k] = df.persist()
        self.frames.move_to_end(k)
        while len(self.frames) > self.bound:
            self.frames.popitem(last=False)[1].unpersist()
        return df

    def clear(self) -> None:
        for df in self.frames.values():
            df.unpersist()
        self.frames.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict:
        return {"entries": len(self.frames), "bound": self.bound, "hits": self.hits, "misses": self.misses}

    def command(self, name: str, *args):
        """get, put, clear, stats by name."""
        if name not in ("get", "put", "clear", "stats"):
            raise GeoError("cache:BadCommand", name)
        return getattr(self, name)(*args)
