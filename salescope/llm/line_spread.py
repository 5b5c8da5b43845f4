"""Line dedup by distinct-site spread.

A line is what stands between line ends, without blanks around it. For each line
hash a HyperLogLog sketch of the sites it occurs on is merged by aggregation.
Lines whose estimate is clearly at or over the threshold are boilerplate, those
clearly under it are not; lines near it get their distinct sites counted
exactly. Boilerplate lines are cut out of every document.

Only DataFrame functions. Hashes and sites are shuffled for counting, texts once
for the cut, and only documents' own lines decide what is cut from them.

Cases: a null text stays null with no lines; an empty text is one empty line;
blank lines are never boilerplate and stay; a null site counts as no site;
repeated rows are cut alike; extra columns are kept by ``without_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.common import written
from salescope.operators.joins import splittable_join

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: Estimates within this factor of the threshold are counted exactly. The sketch
#: errs by about 1.04 / sqrt(2 ** LG_K), 1.6 % here, so by far less.
MARGIN = 0.25
LG_K = 12


def _hashes(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes: one alone would join different lines in a very large corpus."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    lines = docs.select(*keep, F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''")
    return lines.select(*keep, *_hashes(F.col("line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h1, h2) of the lines on at least ``min_sites`` distinct values of ``source``."""
    lines = _lines(docs.select("text", "source"), "source")
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("source", LG_K).alias("sketch"), F.count("source").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN))
    )
    spread = written(spread, "line-spread")
    sure = F.col("sites") > min_sites * (1 + MARGIN)
    near = spread.filter(~sure).select("h1", "h2")
    exact = (
        splittable_join(lines.filter("source is not null"), near, ["h1", "h2"])
        .distinct()
        .groupBy("h1", "h2")
        .count()
        .filter(F.col("count") >= min_sites)
    )
    return written(spread.filter(sure).select("h1", "h2").unionByName(exact.select("h1", "h2")), "boilerplate")


def _cut(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` (_row, doc_id, text) with _kept, the text's remaining lines, and _n_lines."""
    key = ["_id", "_t1", "_t2"]
    keyed = docs.withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            "_t1": F.xxhash64("text"),
            "_t2": F.xxhash64(F.lit(1), F.col("text")),
        }
    )
    found = splittable_join(_lines(keyed, *key), lines, ["h1", "h2"])
    found = found.groupBy(*key).agg(F.collect_set(F.struct("h1", "h2")).alias("_cut"))
    joined = splittable_join(keyed, found, key, "left")
    parts = F.split("text", "\n")
    clean = F.filter(parts, lambda x: ~F.array_contains(F.col("_cut"), F.struct(*_hashes(F.trim(x)))))
    return joined.withColumns(
        {
            "_kept": F.when(F.col("_cut").isNull(), parts).otherwise(clean),
            "_n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long"),
        }
    )


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``; n_chars follows. No row is dropped."""
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    cut = _cut(packed, boilerplate(docs, min_sites))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        changed = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("_cut").isNull(), F.col("_row.n_chars")).otherwise(changed)
    return cut.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row of ``docs``."""
    packed = docs.select(F.lit(0).alias("_row"), "doc_id", "text")
    cut = _cut(packed, boilerplate(docs, min_sites))
    return cut.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.when(F.col("_cut").isNull(), F.lit(0))
        .otherwise(F.col("_n_lines") - F.size("_kept"))
        .cast("long")
        .alias("n_removed"),
        F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
    )
