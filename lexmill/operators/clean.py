"""Cleaning of tabular rows and page texts: projections and filters, no shuffle but for duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SENTINELS = ("nan", "None", "")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(re.sub(r"[\s\-]+", "_", c.strip().lower()) for c in df.columns))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def normalise_strings(df: DataFrame, compose: bool = True) -> DataFrame:
    """String columns: compatibility composition, no control characters, stripped; sentinels become null."""
    names = [c for c, t in df.dtypes if t == "string"]
    clean = {c: tx.normalise(F.col(c), compose) for c in names}
    return df.withColumns(clean).withColumns({c: F.when(~F.col(c).isin(*SENTINELS), F.col(c)) for c in names})


def missing_report(df: DataFrame) -> DataFrame:
    """column_name, n_missing of the columns that have nulls; one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "n_missing").filter("n_missing > 0")


def label_of(column: str) -> str:
    return column.replace("_", " ").title()


def rows_to_records(df: DataFrame, source: str) -> DataFrame:
    """source, text, metadata: 'Label: value. Label: value.' of the columns that have values; rows without any go."""
    parts = [F.concat(F.lit(f"{label_of(c)}: "), F.col(c).cast("string")) for c in df.columns]
    body = F.concat_ws(". ", *parts)
    meta = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(c).cast("string") for c in df.columns)))
    return df.select(F.lit(source).alias("source"), F.concat(body, F.lit(".")).alias("text"), meta.alias("metadata")).filter(F.length("text") > 1)


def join_hyphens(text):
    return F.regexp_replace(text, r"-\n([a-z])", "$1")


def drop_margin_lines(text):
    """Without lines that are page numbers (1 to 4 digits), and without short ones (under 5 characters) among the first and last three."""

    def keep(lines):
        n = F.size(lines)

        def stays(line, i):
            s = tx.strip(line)
            return ~s.rlike(r"^\d{1,4}\z") & ~((F.length(s) < 5) & ((i < 3) | (i > n - 4)))

        return F.array_join(F.filter(lines, stays), "\n")

    # Bound once as a lambda's argument: the lines aren't split again for each line.
    return F.transform(F.array(F.split(text, "\n")), keep)[0]


def clean_page(text, compose: bool = True):
    """A page's text: composition, hyphens, control characters, margin lines, newlines and blanks; stripped."""
    text = join_hyphens(tx.nfkc(text) if compose else text)
    text = drop_margin_lines(F.regexp_replace(text, tx.CONTROL, ""))
    return tx.strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def clean_pages(pages: DataFrame, text: str = "text", least: int = 80, compose: bool = True) -> DataFrame:
    """Pages that aren't blank, cleaned, of more than `least` characters."""
    return tx.with_once(pages.filter(tx.strip(F.col(text)) != ""), text, clean_page(F.col(text), compose)).filter(F.length(text) > least)


def kept_and_skipped(pages: DataFrame, text: str = "text", least: int = 80) -> DataFrame:
    kept = F.length(text) > least
    return pages.agg(F.count_if(kept).alias("n_kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_skipped"))
