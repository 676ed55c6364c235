"""Spelling variants: words one edit apart, found by products of letter counts.

The squared distance of two words' letter counts is |x|^2 + |y|^2 - 2 x.y, so a matrix
product of two blocks of words gives all of their distances. One inserted or deleted letter
makes it 1, a replaced one 2: pairs at most two apart, of equal or adjacent lengths, are
kept and their edits verified letter by letter.

Words are dealt to tasks by length and by how many of their letters are in each of two groups.
An edit moves these numbers by one at most, so each cell meets itself and its neighbours
only. Inside a task, cells by finer groups cut the products down further. A crowded cell
is cut into blocks by hash, and each block meets every block of the neighbour. Tasks emit
a word's number of near words and its best one, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word's least length and number of occurrences, and how often a form must occur for each of its variants.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: One run in so many loses a letter.
DAMAGE = 199
#: Words of a cell that are dealt to one task, and words whose products are taken at a time.
CELL_ROWS, BLOCK = 1 << 16, 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of letters of about equal weight. The first two are the cells of tasks, all of them those inside a task.
GROUPS = ("aehob", "tnsid", "lrcgj", "umwfy")
RUN = "[A-Za-zÀ-ÿ]"
#: Doublings that follow any chain of forms: each is FORM_FACTOR times as frequent as the one before.
DOUBLINGS = 5


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """The words of (doc_id, text), one row an occurrence: runs in lower case, some of them damaged.

    A run shorter than ``least_length`` cannot become a word and is not listed.
    """
    lower = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"({RUN}{{{least_length},}})"), 1)).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.withColumn("h", F.crc32(key.cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, CAST(h % char_length(run) AS INT))"), F.col("run").substr(place + 2, F.char_length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least_length)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``least_count`` occurrences."""
    counts = words_of(docs, least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _held(letters: str) -> Column:
    """How many letters of the word are of the group."""
    return (F.char_length("word") - F.char_length(F.translate("word", letters, ""))).cast("long")


def _coded(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def _letter_counts(coded: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How often each of the sorted letters is in each word."""
    rows, length = coded.shape
    flat = np.repeat(np.arange(rows), length) * len(letters) + np.searchsorted(letters, coded.reshape(-1))
    return np.bincount(flat, minlength=rows * len(letters)).reshape(rows, -1).astype(np.float32)


def _close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows at a squared distance of two at most, by one matrix product."""
    product = x @ y.T
    product *= -2
    product += (x * x).sum(axis=1)[:, None]
    product += (y * y).sum(axis=1)[None, :]
    return np.nonzero(product <= 2.5)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by one edit; the rows of ``b`` are as long, or one longer."""
    short = a.shape[1]
    if b.shape[1] == short:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :short], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(axis=1)
    return ahead + behind >= short


class _Side:
    """Words of one length with their letters, counts and fine cells."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = np.array(words, object), counts
        self.coded = _coded(words, len(words[0]))
        held = [np.isin(self.coded, [ord(c) for c in g]).sum(axis=1) for g in GROUPS]
        cells, self.own = np.unique(np.stack(held, axis=1), axis=0, return_inverse=True)
        self.own = self.own.reshape(-1)
        order = np.argsort(self.own, kind="stable")
        ends = np.cumsum(np.bincount(self.own, minlength=len(cells)))
        starts = np.concatenate([[0], ends[:-1]])
        self.cells = {tuple(c): order[a:b] for c, a, b in zip(cells.tolist(), starts.tolist(), ends.tolist())}


def _moves() -> list[tuple[int, ...]]:
    """How an edit can move the numbers of a word's letters by group."""
    n = len(GROUPS)
    unit = np.eye(n, dtype=int)
    steps = [np.zeros(n, int), *unit, *-unit, *(unit[i] - unit[j] for i in range(n) for j in range(n) if i != j)]
    return [tuple(s.tolist()) for s in steps]


MOVES = _moves()


def near_pairs(left: _Side, right: _Side | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in left, places in right) of the near pairs, each once; of the words of ``left`` if there is no right.

    The words of ``right`` are as long as those of ``left``, or one letter longer.
    """
    other = left if right is None else right
    letters = np.unique(np.concatenate([left.coded.reshape(-1), other.coded.reshape(-1)]))
    for cell, mine in left.cells.items():
        for move in MOVES:
            target = tuple(c + m for c, m in zip(cell, move))
            theirs = other.cells.get(target)
            if theirs is None or (right is None and target < cell):
                continue
            for a in range(0, len(mine), BLOCK):
                x = _letter_counts(left.coded[mine[a : a + BLOCK]], letters)
                for b in range(0, len(theirs), BLOCK):
                    i, j = _close(x, _letter_counts(other.coded[theirs[b : b + BLOCK]], letters))
                    i, j = mine[a + i], theirs[b + j]
                    if right is None and target == cell:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        kept = one_edit(left.coded[i], other.coded[j])
                        yield i[kept], j[kept]


def _best(n_words: int, owner: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near words of each word, place of the best one in the pairs or -1): the largest n, then the least rank."""
    near = np.bincount(owner, minlength=n_words)
    order = np.lexsort((rank, -n, owner))
    first = np.full(n_words, -1)
    head = np.flatnonzero(np.diff(owner[order], prepend=-1) != 0)
    first[owner[order][head]] = order[head]
    return near, first


def _solved(dealt: DataFrame) -> DataFrame:
    """(word, near, best struct(m, form)) of each group of (left, right, i, j, side, word, n): m is minus the form's n."""

    def solve(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        words, counts = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
        sides = [_Side(words[side == s].tolist(), counts[side == s]) for s in (0, 1) if (side == s).any()]
        # A cell that meets itself comes with one side; a neighbour without words leaves nothing to do.
        alone = table.column("alone")[0].as_py()
        out: list[tuple[list, np.ndarray, np.ndarray, list]] = []
        if len(sides) == (1 if alone else 2):
            pairs = list(near_pairs(sides[0], None if alone else sides[1]))
            i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
            other = sides[0] if alone else sides[1]
            if alone:
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
            for mine, theirs, a, b in [(sides[0], other, i, j)] + ([] if alone else [(other, sides[0], j, i)]):
                rank = np.empty(len(theirs.words), int)
                rank[np.argsort(theirs.words, kind="stable")] = np.arange(len(rank))
                near, first = _best(len(mine.words), a, theirs.counts[b], rank[b])
                hit = np.flatnonzero(near)
                chosen = b[first[hit]]
                out.append((mine.words[hit].tolist(), near[hit], -theirs.counts[chosen], theirs.words[chosen].tolist()))
        columns = [[x for part in out for x in part[k]] for k in range(4)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "near", "m", "form"])

    schema = "word string, near long, m long, form string"
    return dealt.groupBy("left", "right", "i", "j").applyInArrow(solve, schema)


def _cell(length: Column, first: Column, second: Column) -> Column:
    return F.struct(length.alias("l"), first.alias("a"), second.alias("b"))


def near_words(words: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(word, n_near, form, form_n) of the rows of (word, n) that have near words; words must be distinct.

    Two words are near if they differ by one inserted, deleted or replaced letter; ``form`` is
    the near word of the largest n, the first in code-point order of several.
    """
    length = F.char_length("word").cast("long")
    placed = words.select("word", "n", _cell(length, _held(GROUPS[0]), _held(GROUPS[1])).alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("long").alias("blocks")).checkpoint()
    # Each pair of cells once: the later one is as long and not before it, or one letter longer.
    steps = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, -1), (1, 0, 0), (1, 1, 0), (1, 0, 1)]
    moved = [_cell(*(F.col(f"cell.{c}") + d for c, d in zip("lab", step))) for step in steps]
    links = cells.select(F.col("cell").alias("left"), F.col("blocks").alias("left_n"), F.explode(F.array(*moved)).alias("right"))
    links = links.join(cells.withColumnsRenamed({"cell": "right", "blocks": "right_n"}), "right")
    same = F.col("left") == F.col("right")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hashed = F.xxhash64("word")
    as_left = placed.join(links, F.col("cell") == F.col("left")).withColumn("own", F.pmod(hashed, "left_n"))
    as_left = as_left.withColumn("other", number("right_n"))
    as_right = placed.join(links.filter(~same), F.col("cell") == F.col("right")).withColumn("own", F.pmod(hashed, "right_n"))
    as_right = as_right.withColumn("other", number("left_n"))
    # Blocks of one cell meet in order, the same pair not twice.
    i = F.when(same, F.least("own", "other")).otherwise(F.col("own"))
    j = F.when(same, F.greatest("own", "other")).otherwise(F.col("other"))
    side = F.when(same & (F.col("own") != i), 1).otherwise(0)
    dealt = as_left.select(
        "left", "right", i.alias("i"), j.alias("j"), side.alias("side"), (same & (i == j)).alias("alone"), "word", "n"
    ).union(
        as_right.select("left", "right", "other", "own", F.lit(1).alias("side"), F.lit(False).alias("alone"), "word", "n")
    )
    parts = _solved(dealt)
    best = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("m", "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form is more frequent than its word by FORM_FACTOR."""
    state = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = state.withColumnsRenamed({"word": "_word", "root": "_root"})
        state = state.join(onward, F.col("root") == F.col("_word"), "left")
        state = state.select("word", F.coalesce("_root", "root").alias("root")).checkpoint()
    return state


def variants(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text, any others).

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` are taken from the whole text (null: none), only A-Z in
    lower case. Where DAMAGE divides the unsigned crc32 h of "<doc_id>:<run>" (a null id is
    empty), the letter at h modulo the length goes. Words are the distinct results of at least six letters that
    occur five times or more; repeated rows count each. ``form`` is the near word of the largest n,
    ties to the first in code-point order, if that is five times the word's n, else null, as is form_n. ``root``
    follows forms to the last. A very long text is one row's list of runs; other columns
    are not looked at; no words give no rows.
    """
    words = word_counts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).checkpoint()
    near = near_words(words, cell_rows)
    found = words.join(near, "word", "left").withColumn("form", F.expr(f"IF(form_n >= {FORM_FACTOR} * n, form, NULL)"))
    found = found.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))).checkpoint()
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )
