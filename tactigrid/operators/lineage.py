"""Derived tables that are rebuilt only when what they were made from has changed.

A build keeps the digests of its inputs beside its version, in a manifest of one row a build. Status:
fresh (all digests as built), stale (one differs), missing_inputs (never built, or an input is gone),
legacy_unknown (built without digests). A partitioned table is rebuilt by partition: rows of changed
keys are made anew from their stored inputs, never patched, and the others are taken over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Make = Callable[[dict[str, DataFrame]], DataFrame]


def digests(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, rows, digest) for each key, or one row for the table: the same for the same rows in any order, repeated rows counted."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    a, b = F.xxhash64(row), F.xxhash64(F.lit(1), row)
    # Sums of 24 bits each: unlike XOR they keep what repeated rows add, and 2**39 rows fit a long.
    part = lambda h, shift: F.hex(F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 24) - 1))))
    digest = F.concat_ws("-", *[F.coalesce(part(h, s), F.lit("0")) for h in (a, b) for s in (0, 24)])
    return df.groupBy(*(key or [])).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def digest(df: DataFrame) -> str:
    r = digests(df).first()
    return f"{r['rows']}:{r['digest']}"


@dataclass
class View:
    """A derived table: its name, the names of its inputs (sources or views), how it is made; with key, it is made partition by partition."""

    name: str
    inputs: list[str]
    make: Make
    key: list[str] = field(default_factory=list)


class Views:
    """Views over named sources, kept under a folder."""

    SCHEMA = "name string, version long, path string, inputs string"

    def __init__(self, spark: SparkSession, folder: str, views: list[View]):
        self.spark, self.folder, self.views = spark, folder, {v.name: v for v in views}

    def builds(self) -> dict[str, dict]:
        """The last build of each view. The manifest has a row for each build, so it grows with builds, not with data."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/manifest").collect()
        except AnalysisException:  # none yet
            rows = []
        out: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: r["version"]):
            out[r["name"]] = r.asDict()
        return out

    def read(self, name: str, sources: dict[str, DataFrame], builds: dict[str, dict] | None = None) -> DataFrame | None:
        """A source, or the last build of a view; None if there is none."""
        if name in sources:
            return sources[name]
        at = (self.builds() if builds is None else builds).get(name)
        try:
            return self.spark.read.parquet(at["path"]) if at else None
        except AnalysisException:  # its files are gone
            return None

    def status(self, sources: dict[str, DataFrame]) -> dict[str, str]:
        """Each view's status against these sources and the stored views."""
        builds, seen, out = self.builds(), {}, {}
        for name, view in self.views.items():
            out[name] = "fresh"
            if name not in builds:
                out[name] = "missing_inputs"
                continue
            made_from = json.loads(builds[name]["inputs"] or "null")
            if made_from is None:
                out[name] = "legacy_unknown"
                continue
            for i in view.inputs:
                df = self.read(i, sources, builds)
                if df is None:
                    out[name] = "missing_inputs"
                    break
                if i not in seen:
                    seen[i] = digest(df)
                if seen[i] != made_from.get(i):
                    out[name] = "stale"
        return out

    def refresh(self, sources: dict[str, DataFrame]) -> dict[str, int]:
        """Rebuilds what is not fresh, in the order of the views (inputs first); gives the versions of the views rebuilt.

        A view whose inputs come out the same again is not rebuilt, so a change stops where it no longer
        shows. Readers see a build once its manifest row is there; versions only grow.
        """
        done: dict[str, int] = {}
        for name, view in self.views.items():
            builds = self.builds()
            inputs = {i: self.read(i, sources, builds) for i in view.inputs}
            if any(df is None for df in inputs.values()):
                continue
            now = {i: digest(df) for i, df in inputs.items()}
            old = builds.get(name)
            made_from = json.loads(old["inputs"] or "null") if old else None
            if made_from == now:
                continue
            version = 1 + max((b["version"] for b in builds.values()), default=0)
            path = f"{self.folder}/{name}/{version}-{uuid.uuid4().hex[:8]}"
            if view.key:
                self.by_key(view, inputs, path, old if made_from is not None else None)
            else:
                view.make(inputs).write.parquet(path)
            row = [(name, version, path, json.dumps(now))]
            self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
            done[name] = version
        return done

    def by_key(self, view: View, inputs: dict[str, DataFrame], path: str, old: dict | None) -> None:
        """Only keys whose input rows have changed are made anew; the digests by key are kept beside the table."""
        each = [digests(df, view.key).select(*view.key, F.lit(i).alias("input"), "rows", "digest") for i, df in inputs.items()]
        now = each[0]
        for x in each[1:]:
            now = now.unionByName(x)
        now.write.parquet(f"{path}-keys")
        now = self.spark.read.parquet(f"{path}-keys")
        if old is None:
            view.make(inputs).write.parquet(path)
            return
        before = self.spark.read.parquet(f"{old['path']}-keys")
        same = [*view.key, "input", "rows", "digest"]
        changed = now.select(*same).exceptAll(before.select(*same)).unionByName(before.select(*same).exceptAll(now.select(*same))).select(*view.key).distinct()
        changed.write.parquet(f"{path}-changed")
        changed = self.spark.read.parquet(f"{path}-changed")
        match = lambda df, how: df.alias("l").join(changed.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in view.key], how)
        anew = view.make({i: match(df, "left_semi") for i, df in inputs.items()})
        kept = match(self.spark.read.parquet(old["path"]), "left_anti")
        kept.unionByName(anew.select(*kept.columns)).write.parquet(path)
