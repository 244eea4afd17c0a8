import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tidepool.llm import bpe, quality

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents
from .test_decontaminate import brute as brute_leaks
from .test_simhash import brute_groups


def test_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    table, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    machine, features = quality.fit_quality(table, labels), quality.Features(quality.WORD_BUCKETS)
    rows = {}
    for doc_id, text, _, _, n in docs:
        words, stats = features(text, n)
        if machine.score(machine.rows(words[None], quality.np.array([stats])))[0] >= 0.3:
            rows[doc_id] = text
    largest = {t: i for i, t in sorted(rows.items())}
    rows = sorted((i, t) for t, i in largest.items())
    named = {i for i, _, c in brute_groups(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in named]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    items = [(j, b) for j, b in items if any(b in t for _, t in rows)]
    leaking = {i for i, _ in brute_leaks([(i, t) for i, t in rows if any(b[:40] in t for _, b in items)], items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    expected = []
    for i, t in rows:
        if i not in leaking:
            ids = library.encode_ordinary(t)
            expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == expected


def test_stages_take_awkward_rows_and_keep_the_columns(spark):
    docs = documents(spark, AWKWARD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.count() <= len(AWKWARD)
        assert stage(spark, docs.limit(0), SF_SMALL).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF_SMALL).count() == len(AWKWARD) and last(spark, docs.limit(0), SF_SMALL).collect() == []
