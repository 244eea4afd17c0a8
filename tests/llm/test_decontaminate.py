import random
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import decontaminate as D

from ..conftest import SF_CHECK
from .helpers import AWKWARD, documents, with_clashes


def words_of(text):
    return [p for p in (w.lower().strip(D.EDGES) for w in (text or "").split()) if p]


def brute(rows, items, similarity=0.8):
    """{(doc, item): (best similarity, first best word)} over all windows, without fingerprints."""
    out = {}
    for i, text in rows:
        words = words_of(text)
        for j, item in items:
            own = words_of(item)
            n, k = len(own), min(5, len(own))
            if not n:
                continue
            weights = Counter(tuple(own[a:a + k]) for a in range(n - k + 1))
            best = (0.0, -1)
            for a in range(len(words) - n + 1):
                window = Counter(tuple(words[b:b + k]) for b in range(a, a + n - k + 1))
                shared = sum((weights & window).values())
                best = max(best, (shared / (2 * (n - k + 1) - shared), -a))
            if best[0] >= similarity:
                out[i, j] = (round(best[0], 9), -best[1])
    return out


def benchmark(spark, items):
    return with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))


def planted(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 12, 16, 20, 33, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    rows = []
    for i in range(60):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        if i % 2:
            passage = rnd.choice(items[:30])[1].split()
            if i % 3 == 0 and len(passage) > 15:  # an edit that leaves it similar enough, or not
                passage[rnd.choice([0, 1, len(passage) // 2, -1])] = "edited"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() + "," if i % 5 == 0 else w for w in passage]
        rows.append((i, "\n ".join(text)))
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_against_brute_force(spark, block_bytes):
    rows, items = planted(8)
    found = D.find_leaks(documents(spark, rows), benchmark(spark, items), block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in found} == brute(rows, items)
    docs = documents(spark, rows)
    clean = D.without_leaks(docs, benchmark(spark, items), block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in brute(rows, items)}


def brute_short(rows, items, similarity=0.8):
    """{(doc, item): (similarity, first word, words)} of the documents with fewer words than the item."""
    out = {}
    for i, text in rows:
        for j, item in items:
            words, own = words_of(text), words_of(item)
            if len(words) < len(own):
                k = min(5, len(own))
                a, b = (Counter(tuple(x[at:at + k]) for at in range(len(x) - k + 1)) for x in (words, own))
                found = (a & b).total() / (a | b).total()
                if found >= similarity:
                    out[i, j] = (round(found, 9), 0, len(words))
    return out


def test_documents_shorter_than_the_item(spark):
    rnd = random.Random(3)
    items = [(n, " ".join(f"w{rnd.randrange(400)}" for _ in range(n))) for n in (3, 5, 6, 8, 9, 10, 13, 20, 33, 60, 200)]
    items += [(1000 + n, item.replace(" ", " x ", 1)) for n, item in items] + [(2000, "again and again and again and again and again")]
    cut = [item.split()[first:last] for _, item in items for first in (0, 1, 5) for last in (None, -1, -2, -6, -12, -14)]
    rows = [(i, " ".join(words)) for i, words in enumerate(cut)]
    expected = brute_short(rows, items)
    assert len(expected) > 50 and {x for x, _, _ in expected.values()} > {0.8} and next(x for (i, j), (x, _, _) in expected.items() if (i, j) == (9 * 18 + 1, 60)) == round(55 / 56, 9)
    for block_bytes in (1 << 20, 700):
        found = D.find_leaks(documents(spark, rows), benchmark(spark, items), block_bytes=block_bytes).collect()
        n_words = {i: len(words_of(t)) for i, t in rows}
        assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in found if n_words[r.doc_id] < len(words_of(dict(items)[r.item_id]))} == expected
    kept = {r.doc_id for r in D.without_leaks(documents(spark, rows), benchmark(spark, items)).collect()}
    assert not kept & {i for i, _ in expected} and kept == {i for i, _ in rows} - {i for i, _ in expected} - {i for i, _ in brute(rows, items)}


def test_awkward_rows(spark):
    items = [(1, "some text of words"), (None, "naïve café 漢字"), (2, None), (3, "lorem ipsum dolor " * 10)]
    found = D.find_leaks(documents(spark, AWKWARD), benchmark(spark, items)).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(1, 1), (6, 1), (6, 1), (7, 1), (None, 1), (8, None), (5, 3)], key=str)
    assert D.find_leaks(documents(spark, AWKWARD).limit(0), benchmark(spark, items)).collect() == []
    assert D.find_leaks(documents(spark, AWKWARD), benchmark(spark, items).limit(0)).collect() == []
    assert D.without_leaks(documents(spark, AWKWARD), benchmark(spark, items).limit(0)).count() == len(AWKWARD)
    with pytest.raises(ValueError):
        D.find_leaks(documents(spark, AWKWARD), benchmark(spark, items), blocks=7)


@pytest.mark.parametrize("radius,blocks", [(3, 4), (10, 8), (20, 16)])
def test_blocks_give_all_fingerprints_within_the_radius(radius, blocks):
    rng = np.random.default_rng(radius)
    items = [(i, rng.integers(0, 1 << 63, 12, dtype=np.uint64)) for i in range(40)]
    index = D.SizeIndex(16, 5, items, radius, blocks)
    fps = np.concatenate([index.fps ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), replace=False)) for _ in index.fps], dtype=np.uint64)
                          for _ in range(5)])
    window, item = index.candidates(fps)
    near = np.bitwise_count(fps[:, None] ^ index.fps[None, :]) <= radius
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_query_finds_the_planted_passages(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in D.op5_decontamination(spark, SF_CHECK).collect()}
    assert found >= {(i, j) for i, t in rows for j, b in items if b in t}
    shared = {s for _, b in items for s in zip(*(words_of(b)[k:] for k in range(5)))}
    near = [(i, t) for i, t in rows if any(s in shared for s in zip(*(words_of(t)[k:] for k in range(5))))]
    assert found == set(brute(near[:40], items)) | {f for f in found if f[0] not in {i for i, _ in near[:40]}}


def test_items_repeated_beyond_a_block(spark):
    text = "one two three four five six seven eight nine ten"
    docs, items = documents(spark, [(1, f"so {text} it is"), (2, "nothing of it")]), benchmark(spark, [(5, text)] * 300 + [(6, text), (None, text)])
    assert len(D.item_blocks(items.select("item_id", "text"), 200)) < 8
    found = Counter(r.item_id for r in D.find_leaks(docs, items, block_bytes=200).collect())
    assert found == {5: 300, 6: 1, None: 1}
    assert [r.doc_id for r in D.without_leaks(docs, items, block_bytes=200).collect()] == [2]
