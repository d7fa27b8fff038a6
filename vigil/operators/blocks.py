"""Exports of message channels as blocks: one row per post, with its index in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

# The line before each message of an export.
HEADER = r"[^\n]+, \[\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}\]"
# End of fixed values.


def block_array(text: Column) -> Column:
    """Blocks of an export: cut before header lines where there are any, else at blank lines; trimmed, empty ones dropped."""
    t = trim(F.replace(text, F.lit("\r"), F.lit("")))
    by_header, by_blank = F.split(t, rf"\n(?={HEADER}(?:\n|\z))"), F.split(t, r"\n{2,}")
    cut = F.when(t.rlike(rf"(?:\A|\n){HEADER}(?:\n|\z)"), by_header).otherwise(by_blank)
    return F.filter(F.transform(cut, trim), lambda x: x != "")


def split_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per block: the other columns of files, index (from 0) and raw_text. Files without blocks give no rows."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(block_array(F.col(text))).alias("index", "raw_text"))
