"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, spans int, row int, fp int"


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["stone", "river", "Äpfel", "the", "of", "a,", "über", "road.", "wind", "idiot"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = line(40), line(120)
    rows: list[tuple[int | None, str | None]] = [(i, line(rng.randint(1, 90))) for i in range(30)]
    rows += [(100 + i, f"{line(5)} {passage}\n{line(7)}") for i in range(6)]
    rows += [(200 + i, base if i < 3 else f"{base} {line(2)}") for i in range(6)]
    rows += [
        (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "two words"),
        (306, "a " * 700), (307, "x" * 30_000), (308, "\x00\x01 ▁ 😀 é"), (309, line(6_000)),
        (None, passage), (None, None), (310, base), (310, base), (311, line(30)), (311, line(30)),
    ]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    """With extra columns whose names the operators might use themselves."""
    whole = [(i, t, "en", "s", len(t or ""), "p", 1, 2, 3) for i, t in (texts() if rows is None else rows)]
    return spark.createDataFrame(whole, SCHEMA).repartition(4)


def plain(docs: DataFrame) -> list[tuple[int | None, bytes]]:
    return [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]


def sorted_rows(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, str(v)) for v in r))
