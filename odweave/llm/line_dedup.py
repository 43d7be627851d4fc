"""Line dedup by site-relative frequency, with built-in functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it, over all
pages of the host. Lines above ``max_ratio`` are boilerplate and leave every page of that host.

Defined results: a null host is a host of its own; a null text stays null and counts as a page; blank
lines are never boilerplate; a line that a page repeats counts once for it; repeated rows are pages of
their own; ids may be null or repeat; other columns pass through, those named n_lines or n_dropped are replaced; an empty table gives an empty table.
A page whose lines all go keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of the small side of a join, so that one host or line doesn't meet in one task.
SALTS = 32

MAX_RATIO = 0.10
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line digest) of every boilerplate line, from one partial and one final count.

    Host totals are joined on (host, salt): a host with a third of all lines is dealt to SALTS keys.
    """
    each = pages.select(
        F.col(host).alias("_host"), F.explode(F.array_distinct(_lines(F.col(text)))).alias("_line")
    ).filter(F.trim("_line") != "")
    counts = (
        each.groupBy("_host", _digest(F.col("_line")).alias("_digest"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_pages)
        .withColumn("_salt", _salt(F.col("_digest")))
        .withColumnRenamed("_host", "_lhost")
    )
    totals = _salted(pages.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_total")))
    return counts.join(
        totals,
        counts["_lhost"].eqNullSafe(totals["_host"]) & (counts["_salt"] == totals["_salt"]),
    ).filter(F.col("_n") > max_ratio * F.col("_total")).select("_host", "_digest")


def line_dedup(
    pages: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """pages without their boilerplate lines, plus ``n_lines`` and ``n_dropped``.

    A line goes when more than max_ratio of its host's pages, and at least min_pages of them, hold it.
    Texts are shuffled once, at the end; up to there only digests of lines are.
    """
    bad = _salted(boilerplate(pages, host_col, text_col, max_ratio, min_pages))
    each = (
        pages.select(
            F.col(id_col).alias("_id"),
            F.col(host_col).alias("_phost"),
            F.explode(F.array_distinct(_lines(F.col(text_col)))).alias("_line"),
        )
        .filter(F.trim("_line") != "")
        .select("_id", "_phost", _digest(F.col("_line")).alias("_pdigest"))
        .withColumn("_psalt", _salt(F.col("_id")))
    )
    hits = (
        each.join(
            bad,
            each["_phost"].eqNullSafe(bad["_host"])
            & (each["_pdigest"] == bad["_digest"])
            & (each["_psalt"] == bad["_salt"]),
        )
        .groupBy("_id", "_phost")
        .agg(F.collect_set("_digest").alias("_drop"))
    )
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", _digest(x)))
    out = (
        pages.join(
            hits.hint("shuffle_hash"),
            pages[id_col].eqNullSafe(hits["_id"]) & pages[host_col].eqNullSafe(hits["_phost"]),
            "left",
        )
        .withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
        .withColumn("n_lines", F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0))
        .withColumn(
            "n_dropped",
            F.when(F.col("_drop").isNotNull(), F.col("n_lines") - F.size("_kept")).otherwise(0),
        )
        .withColumn(
            text_col,
            F.when(F.col("_drop").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text_col)),
        )
    )
    return out.select(*[c for c in pages.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
