"""Sort-merge range join of urls with host and path rules.

Host labels are reversed (``www.example.org`` becomes ``org.example.www.``), so
a rule covers one interval of the sorted keys: its own key and everything that
begins with it.  Urls and rules are cut into the same key ranges at sampled
splitters, sorted, and swept once per range; the sweep keeps a stack of the
rules whose interval is still open.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals.llm.text import ascii_lower

URLS_PER_RANGE = 20_000
SAMPLES_PER_RANGE = 16
MAX_RANGES = 20_000
DEFAULT_VERDICT = "allow"
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class _Paths:
    """The open rules of one stack state as nested path intervals."""

    def __init__(self, rules: list[tuple[str, str, int, str]]):
        best: dict[str, tuple[int, int, int, str]] = {}
        for path, verdict, host_length, text in rules:
            rank = (len(text), host_length, verdict == "block", text)
            if path not in best or rank[:3] > best[path][:3]:
                best[path] = rank
        self.paths = sorted(best)
        self.winner: list[tuple[int, int, int, str]] = []
        self.outer: list[int] = []
        open_: list[int] = []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            mine = best[path]
            self.winner.append(max(mine, self.winner[open_[-1]], key=lambda r: r[:3]) if open_ else mine)
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def find(self, path: str) -> tuple[int, int, int, str] | None:
        i = bisect.bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.winner[i] if i >= 0 else None


class Sweep:
    """Walks ``(range, key, kind, path, verdict, text)`` rows in sorted order; rules have kind 0."""

    def __init__(self, default: str):
        self.default = default
        self.part = None
        self.stack: list[tuple[str, list[tuple[str, str, int, str]]]] = []
        self.paths: _Paths | None = None

    def judge(self, rows: Iterable[tuple]) -> Iterator[tuple[str | None, str]]:
        """(rule, verdict) of each url; the open rules stay for the next rows."""
        for part, key, kind, path, verdict, text in rows:
            if part != self.part:
                self.part, self.stack, self.paths = part, [], None
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
                self.paths = None
            if kind == 0:
                if not self.stack or self.stack[-1][0] != key:
                    self.stack.append((key, []))
                self.stack[-1][1].append((path, verdict, len(key), text))
                self.paths = None
                continue
            if self.paths is None:
                self.paths = _Paths([rule for _, rules in self.stack for rule in rules])
            won = self.paths.find(path)
            yield (None, self.default) if won is None else (won[3], "block" if won[2] else "allow")


def _splitters(keyed: DataFrame) -> list[tuple[str, str]]:
    """Quantile boundaries of a hash sample of (key, path, row hash); at most ``MAX_RANGES``, whatever the size."""
    n = keyed.count()
    ranges = min(-(-n // URLS_PER_RANGE), MAX_RANGES)
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLES_PER_RANGE / n)
    sample = (
        keyed.where(F.pmod("_spread", F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
        .select("_key", "_path", "_spread")
        .distinct()
        .collect()
    )
    points = sorted((r[0], r[1], r[2]) for r in sample)
    return [points[i * len(points) // ranges] for i in range(1, ranges)] if points else []


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).  A
    rule fits its host and all subdomains if the url's path starts with the
    rule's.  Of several, the longest ``host`` + ``path`` wins, then the longer
    host, then ``block``; without one ``rule`` is null and the verdict is
    ``default``.  Null urls and urls without ``://`` have an empty host and path.
    Repeated rows are judged one by one; columns of ``urls`` with the four new
    names are replaced, others pass unread.  Rules with a null part never fit.
    """
    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in urls.columns if c not in new]
    keyed = (
        urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{url}`").alias("_url"))
        .withColumn("_host", host_of(F.col("_url")))
        .withColumn("_path", path_of(F.col("_url")))
        .withColumn("_key", reversed_host(F.col("_host")))
        .withColumn("_spread", F.xxhash64("_row"))
    )
    points = _splitters(keyed.select("_key", "_path", "_spread"))

    @F.pandas_udf(T.IntegerType())
    def range_of(keys: pd.Series, paths: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(points, at) for at in zip(keys, paths, spread)], dtype="int32")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges_of(keys: pd.Series) -> pd.Series:
        firsts = [p[0] for p in points]
        return pd.Series(
            [list(range(bisect.bisect_left(firsts, k), bisect.bisect_right(firsts, k + _LAST) + 1)) for k in keys]
        )

    placed = keyed.select(
        range_of("_key", "_path", "_spread").alias("_range") if points else F.lit(0).alias("_range"),
        "_key", F.lit(1).alias("_kind"), "_path", F.lit(None).cast("string").alias("_verdict"),
        F.lit(None).cast("string").alias("_text"), "_host", "_row",
    )
    opened = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(reversed_host(ascii_lower(F.col("host"))).alias("_key"), F.col("path").alias("_path"),
                F.col("verdict").alias("_verdict"), F.concat("host", "path").alias("_text"))
        .withColumn("_range", F.explode(ranges_of("_key")) if points else F.lit(0))
        .select("_range", "_key", F.lit(0).alias("_kind"), "_path", "_verdict", "_text",
                F.lit(None).cast("string").alias("_host"),
                F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"))
    )
    ordered = (
        placed.unionByName(opened)
        .repartition("_range")
        .sortWithinPartitions("_range", "_key", "_kind", "_path")
    )
    columns = ["_range", "_key", "_kind", "_path", "_verdict", "_text"]

    def swept(batches):
        sweep = Sweep(default)
        for batch in batches:
            table = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            found = list(sweep.judge(zip(*[table[c].to_pylist() for c in columns])))
            is_url = pc.equal(table["_kind"], 1)
            yield pa.RecordBatch.from_arrays(
                [table[c].filter(is_url) for c in ("_row", "_host", "_path")]
                + [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)],
                names=["_row", "host", "path", "rule", "verdict"],
            )

    schema = T.StructType([
        placed.schema["_row"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
    ])
    out = ordered.mapInArrow(swept, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], "host", "path", "rule", "verdict")
