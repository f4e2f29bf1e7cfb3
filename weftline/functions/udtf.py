"""Table functions in Python, for what no expression states; built-in functions are faster where they do."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_BREAK = re.compile(r"(?<=[.!?])[ \t\n]+")


@F.udtf(returnType="sentence_no int, begin_pos int, end_pos int, sentence string")
class Sentences:
    """A row for each sentence of a text with its places, so that the text can be cut there; none for a null or blank text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        at, number = 0, 0
        for m in [*_BREAK.finditer(text or ""), None]:
            end = m.start() if m else len(text or "")
            if (text or "")[at:end].strip(" \t\n"):
                yield number, at, end, text[at:end]
                number += 1
            at = m.end() if m else at


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: ``select ... from documents, lateral sentences(text)``."""
    spark.udtf.register("sentences", Sentences)
