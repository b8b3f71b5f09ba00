"""The table of common words on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows the table of common words may have before it is sent to tasks.
MOST_WORDS = 100_000


def common_words(words: DataFrame, most: int = MOST_WORDS) -> list[tuple[str | None, str]]:
    """(lang, word) rows in lower case; a table above ``most`` rows is an error, never cut."""
    rows = words.filter(F.col("word").isNotNull()).select("lang", "word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table of common words has more than {most} rows")
    return [(None if r["lang"] is None else r["lang"].strip().lower(), r["word"].lower()) for r in rows]
