"""Finds license notices in texts, with DataFrame functions only.

A text's five-word shingles are cut into blocks; two neighbouring blocks make a
window, so windows overlap by half and any notice of at most one block lies
whole inside some window.  MinHash bands of one row each retrieve the
templates, and the notice's exact shingles are then looked for in the window.
All of it happens inside a row: no text and no signature is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_signals.llm import license_texts
from incident_signals.llm.text import ascii_lower

SHINGLE = 5
CONTAINED = 0.8
GUARANTEE = 0.999
WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
TEMPLATES = license_texts.NOTICES + license_texts.HEADERS + license_texts.WHOLE


def word_list(text: Column) -> Column:
    """Lower-case words of letters, digits and everything beyond ASCII; null has none."""
    parts = F.split(F.coalesce(ascii_lower(text), F.lit("")), WORD)
    return F.array_remove(parts, "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """64-bit hash of each run of ``width`` words; fewer words, but not none, are one shingle."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        each = F.transform(
            F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.get(hashes, i - 1 + j) for j in range(width)])
        )
        return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def block_size(shingles: int) -> int:
    """Shingles of a block: the power of two that holds the whole template."""
    return 1 << max(0, math.ceil(math.log2(max(1, shingles))))


def least_shared(shingles: int) -> int:
    return math.ceil(CONTAINED * shingles)


def bands_for(shingles: int) -> int:
    """One-row bands that retrieve a contained template with at least the guaranteed probability."""
    window = 2 * block_size(shingles)
    shared = least_shared(shingles)
    similarity = shared / (window + shingles - shared)
    return 1 if similarity >= 1 else math.ceil(math.log(1 - GUARANTEE) / math.log(1 - similarity))


def _masks(n: int) -> list[int]:
    """Fixed bit masks; each xor is a permutation of the 64-bit hashes, ordered by its leading bits."""
    state, out = 0x9E3779B97F4A7C15, []
    for i in range(n):
        state = (state * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)
        # leading bits run through all values in turn, so that the orders differ from the first bit on
        lead = int(format(i % 256, "08b")[::-1], 2) << 56
        value = lead | (state & ((1 << 56) - 1))
        out.append(value - (1 << 64) if value >= 1 << 63 else value)
    return out


def _least(hashes: Column, mask: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(mask)))


def _numbers(values: Sequence[int]) -> Column:
    """An array of whole numbers that the optimizer folds to one value, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """One row per text and license found in it.

    Adds to the columns of ``docs``: ``license``, ``template_shingles``,
    ``shared_shingles`` (most in one window) and ``first_word`` (word number where
    the first such window begins).  A license is found if a window holds at
    least 0.8 of its template's distinct shingles.  Null and empty texts, and
    texts of fewer words than the template's shared shingles need, hold none.
    Repeated rows give repeated results.  Columns of ``docs`` with the new names
    are replaced.  ``templates`` is a list in the driver, so its size is bounded.
    """
    spark: SparkSession = docs.sparkSession
    new = ["license", "template_shingles", "shared_shingles", "first_word"]
    kept = [c for c in docs.columns if c not in new]
    rows = [(name, content) for name, content in templates]
    listed = (
        spark.createDataFrame(rows, "license string, content string")
        .select("license", F.array_distinct(shingle_hashes(word_list(F.col("content")))).alias("_own"))
        .where(F.size("_own") > 0)
        .collect()
    )
    if not listed:
        return docs.where(F.lit(False)).select(
            *kept, F.lit("").alias("license"), F.lit(0).alias("template_shingles"),
            F.lit(0).alias("shared_shingles"), F.lit(0).alias("first_word"),
        )
    sizes = {name: block_size(len(own)) for name, own in listed}
    most_bands = max(bands_for(len(own)) for _, own in listed)
    masks = _masks(most_bands)
    signs = {name: [min(h ^ m for h in own) for m in masks] for name, own in listed}

    hashed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.lit(1).alias("_one"),
        F.col(f"`{text}`").alias("_text"),
    )
    per_size = []
    for size in sorted(set(sizes.values())):
        own = {name: shingles for name, shingles in listed if sizes[name] == size}
        bands = max(bands_for(len(shingles)) for shingles in own.values())
        keys = [sorted({signs[name][k] for name in own}) for k in range(bands)]
        per_size.append((size, keys))
    # a band can only meet in a window that holds the shingle behind one of the templates' minima
    behind = sorted({key ^ masks[k] for _, keys in per_size for k, at_k in enumerate(keys) for key in at_k})

    def candidates(hashes: Column) -> Column:
        """Structs (size, at) of the windows in which a band meets a template's."""
        marked = F.filter(
            F.transform(hashes, lambda h, i: F.when(h.isin(behind), i)), lambda i: i.isNotNull()
        )

        def of_size(at: Column, size: int, keys: list[list[int]]) -> Column:
            bands = F.array(*[
                F.struct(F.lit(mask).cast("long").alias("mask"), _numbers(at_k).alias("keys")) for mask, at_k in zip(masks, keys)
            ])
            starts = (
                at if size == 1
                else F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(
                    F.greatest(F.floor(i / size).cast("int") - 1, F.lit(0)) * size, F.floor(i / size).cast("int") * size
                ))))
            )
            met = F.filter(starts, lambda i: _let(
                F.slice(hashes, i + 1, 1 if size == 1 else 2 * size),
                lambda inside: F.exists(bands, lambda band: F.array_contains(band["keys"], _least(inside, band["mask"]))),
            ))
            return F.transform(met, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at")))

        return _let(marked, lambda at: F.when(
            F.size(at) > 0, F.flatten(F.array(*[of_size(at, size, keys) for size, keys in per_size]))
        ))

    words = hashed.select("_row", F.explode(F.array(word_list(F.col("_text")))).alias("_words"))
    shingled = words.select("_row", "_words", F.explode(F.array(shingle_hashes(F.col("_words")))).alias("_hashes"))
    placed = shingled.select("_row", "_hashes", F.explode(F.array(candidates(F.col("_hashes")))).alias("_windows")).where(
        F.size("_windows") > 0
    )

    # one value in the plan, whatever the number of templates
    given = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.lit(len(own)).alias("whole"), F.lit(least_shared(len(own))).alias("least"),
            F.lit(sizes[name]).alias("size"), F.lit(1 if sizes[name] == 1 else 2 * sizes[name]).alias("window"),
            _numbers(own).alias("own"),
        )
        for name, own in listed
    ])

    def match(template: Column) -> Column:
        """Most of the template's shingles in one window, and the first window that has them."""
        shared = F.transform(
            F.filter("_windows", lambda w: w["size"] == template["size"]),
            lambda w: F.struct(
                F.size(F.array_intersect(F.slice("_hashes", w["at"] + 1, template["window"]), template["own"])).alias("shared"),
                (-w["at"]).alias("back"),
            ),
        )
        return _let(F.array_max(shared), lambda best: F.struct(
            template["license"].alias("license"), template["whole"].alias("template_shingles"),
            best["shared"].alias("shared_shingles"), (-best["back"]).alias("first_word"), template["least"].alias("least"),
        ))

    matches = placed.select("_row", F.explode(F.transform(given, match)).alias("_match"))
    return (
        matches.where("_match.shared_shingles >= _match.least")
        .select(*[F.col("_row").getField(c).alias(c) for c in kept], *[F.col("_match").getField(c).alias(c) for c in new])
    )
