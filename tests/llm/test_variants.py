import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import variants
from spendlens.llm.queries import op11_variants
from tests.llm.cases import documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {c: c + 32 for c in range(65, 91)}


def edits(word, letters):
    """All texts one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    out |= {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w, n in words.items():
        own = [v for v in edits(w, letters) if v in words]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def found(frame, **sizes):
    return sorted(tuple(r) for r in variants.variants(frame, **sizes).collect())


def corpus(seed=4):
    """Families of words around frequent ones, in chains of falling frequency, accents among them."""
    rng = random.Random(seed)
    letters = "abcdeéàÿÀÖ"
    bag = []
    for _ in range(25):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        n = rng.choice([900, 300])
        for _ in range(6):
            bag += [rng.choice([word, word.title()])] * n
            if not rng.randrange(3):
                n = max(5, n // rng.choice([1, 5, 6]))
            word = rng.choice(sorted(edits(word, letters)))
    rng.shuffle(bag)
    return [(i, " ".join(bag[i * 50 : i * 50 + 50])) for i in range(len(bag) // 50 + 1)]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 2}])
def test_equals_brute_force(spark, sizes):
    rows = corpus()
    want = brute(rows)
    assert any(w[1] for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), **sizes) == want


def test_fine_cells_and_blocks(monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 3)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abtlué") for _ in range(6)) for _ in range(300)})
    longer = sorted({"".join(rng.choice("abtlué") for _ in range(7)) for _ in range(300)})
    for right in (None, longer):
        sides = [variants._Side(w, np.ones(len(w), int)) if w else None for w in (words, right)]
        got = [(int(a), int(b)) for i, j in variants.near_pairs(*sides) for a, b in zip(i, j)]
        other = right or words
        place = {w: k for k, w in enumerate(other)}
        want = {(a, place[v]) for a, w in enumerate(words) for v in edits(w, "abtlué") if v in place}
        if right is None:
            want = {tuple(sorted(p)) for p in want}
            got = [tuple(sorted(p)) for p in got]
        assert len(got) == len(set(got)) and set(got) == want


def test_awkward_rows_and_empty_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(7, "Straße straße STRASSE strasse " * 9), (None, "straſse ×÷× ÀÀÀÀÀÀ " * 9), (8, "y" * 200_000)]
    assert found(documents(spark, rows)) == brute(rows)
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, None), (2, "")])) == []


def test_query_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in op11_variants(spark, sf_dir).collect()) == brute([tuple(r) for r in docs])
