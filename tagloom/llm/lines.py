"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Each line's sites are gathered in a HyperLogLog sketch, which Spark merges by aggregation. Lines whose
estimate lies near the threshold get an exact count of their sites, so the sketch's error decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import stored

#: Sites from which a line is boilerplate.
MIN_SITES = 10
#: Base-2 logarithm of the sketches' registers (4096: standard error 1.6 %), and the part of the
#: threshold around it in which sites are counted exactly (over ten standard errors).
REGISTERS, NEAR = 12, 0.2


def _key(line: Column) -> Column:
    """128 bits of a line without the white space at its ends."""
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """The lines of each text that hold more than white space: doc_id, site, place (from 0), line (its key)."""
    cut = docs.select("doc_id", F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return cut.withColumn("line", F.trim(F.regexp_replace("line", r"[\t\x0B\f\r]", " "))).filter("line <> ''").withColumn(
        "line", _key(F.col("line"))
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (column line) on at least ``min_sites`` sites, with n_sites, exact near the threshold.

    A null site counts as no site.
    """
    known = lines.filter("site is not null")
    # A line that stands nowhere else needs no sketch; counting first keeps sketches few.
    often = known.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line")
    common = known.join(often, "line", "left_semi").select("line", F.col("site").cast("string").alias("site"))
    sketched = stored(
        common.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("about")),
        "line-sites",
    )
    near = sketched.filter(F.col("about").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    exact = (
        common.join(near.select("line"), "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n_sites"))
    )
    sure = sketched.filter(F.col("about") > min_sites * (1 + NEAR)).select("line", F.col("about").alias("n_sites"))
    return sure.union(exact.filter(F.col("n_sites") >= min_sites))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", keep_first: bool = True) -> DataFrame:
    """Lines to remove: doc_id and places, an ascending list of line numbers from 0.

    With ``keep_first`` a line stays where it occurs first (smallest doc_id, then place), so that no text
    is lost altogether.
    """
    lines = stored(lines_of(docs.filter("doc_id is not null"), site), "lines")
    spread = spread_lines(lines, min_sites)
    if keep_first:
        first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "place")).alias("first"))
        spread = spread.join(first, "line")
    found = lines.join(spread, "line")
    if keep_first:
        found = found.filter(F.struct("doc_id", "place") != F.col("first"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    site: str = "source",
    keep_first: bool = True,
    names: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """Texts without cross-site boilerplate lines: the columns of ``docs``, n_lines and n_removed (or ``names``),
    which take the place of columns with those names.

    A text's other lines stay as they are. Null texts stay null, with 0 lines; a text all of whose lines
    go is left empty. White space at a line's ends doesn't matter, blank lines always stay, and so do all lines
    of rows with a null doc_id. Rows with the same doc_id lose the lines at the same places. A table of
    no rows gives none. Needs doc_id, text and the site column.
    """
    own = [c for c in docs.columns if c not in names]
    inner = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in own]).alias("row"))
    places = boilerplate(docs.select("doc_id", "text", site), min_sites, site, keep_first)
    # The places grow with the documents, so both sides are dealt by id whatever their size.
    joined = inner.hint("merge").join(places, "doc_id", "left")
    cut = F.split("text", "\n")
    left = F.array_join(F.filter(cut, lambda line, at: ~F.array_contains("places", at)), "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(left)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own],
        F.greatest(F.coalesce(F.size(cut), F.lit(0)), F.lit(0)).alias(names[0]),
        F.coalesce(F.size("places"), F.lit(0)).alias(names[1]),
    )
