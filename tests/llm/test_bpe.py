import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tidepool.llm import bpe

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "abcXYZ  \t\n\r\x0b\x85\xa0 　'srtvemld019²½①éßñ漢字かな😀%$#@!"


def digests(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (64, 16), (9, 3)])
def test_awkward_rows_as_the_library_would(spark, chunk, overlap):
    rows = [(i, t if t is None or chunk > 100 else t[:500]) for i, t in AWKWARD]
    df = bpe.round_trip_digests(documents(spark, rows), PATH, chunk_chars=chunk, overlap_chars=overlap)
    assert sorted(map(tuple, df.collect()), key=str) == sorted((digests(*r) for r in rows), key=str)


def test_encode_and_decode(spark):
    docs = documents(spark, AWKWARD)
    ids = bpe.encode(docs, PATH)
    back = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(ids, PATH).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in AWKWARD), key=str)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, chunk_chars=5, overlap_chars=5)


def test_stitched_chunks_are_the_whole_texts_pieces():
    rnd, find = random.Random(4), regex.compile(public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.2:
            text = text[:10] + rnd.choice(" a%") * 40 + text[10:]
        size = rnd.randint(4, 20)
        overlap = rnd.randint(1, size - 1)
        starts = range(0, max(1, len(text) - overlap), size - overlap)
        chunks = [(s, bpe.chunk_bounds(text[s:s + size], find, s + size >= len(text))) for s in starts]
        assert bpe.stitch(text, chunks, find) == find.findall(text)


def test_long_texts_take_time_in_proportion(spark):
    def seconds(n):
        text, run = "Some words, of a text 12. " * n, bpe._stitched(lambda: encoder, lambda e, ids: (ids,), bpe.IDS)
        size, overlap = 1 << 12, 1 << 8
        began, cut = time.process_time(), bpe._cut(size, size - overlap)
        batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text])], names=["row", "doc_id", "text"])
        marked = list(bpe._bounds(public_tokenizers.PATTERN)(cut(iter([batch]))))
        ids = run(pa.Table.from_batches(marked)).column("ids")[0].as_py()
        assert encoder.decode(ids).decode() == text
        return time.process_time() - began

    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    seconds(10_000)
    assert seconds(400_000) < 3 * seconds(200_000)


def test_merges_match_the_library():
    rnd, encoder = random.Random(5), bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_pieces=50)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    for text in [*texts, "a" * 3000, "%" * 2000, "é" * 900, " " * 4000 + "x", "ab" * 900]:
        ids = encoder.ids(encoder.pieces(text))
        assert ids == LIBRARY.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_query_as_the_library_would(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, bpe.op7_bpe(spark, SF_SMALL).collect())) == sorted(digests(*r) for r in rows)
