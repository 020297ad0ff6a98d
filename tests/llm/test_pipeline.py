"""The pipeline against a brute-force version of its five stages."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from filingmatch.llm import byte_bpe

from .fixtures import documents, sample
from .test_dedup import SPACE, closed, fingerprint
from .test_text import WORD, lower


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [r for r in sample() if r[0] is not None]
    rows = [(i, t, "en") for i, t, _ in rows]
    near = rows[9][1].split()
    rows += [(300 + k, " ".join(near[:k] + ["zq"] + near[k + 1:]), "en") for k in range(0, min(30, len(near)), 3)]
    item = " ".join(rows[11][1].split()[:15])
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "words nobody wrote")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    groups = {}
    for i, t in left:
        groups.setdefault(SPACE.sub("", t), []).append((-len(t), i, t))
    left = [(i, t) for g in groups.values() for _, i, t in [min(g)]]
    fps = {fingerprint(t) for _, t in left}
    comp = closed([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    first = {}
    for i, t in sorted(left):
        first.setdefault(comp[fingerprint(t)], (i, t))
    words = WORD.findall(lower(item))
    windows = {tuple(words[k:k + 10]) for k in range(len(words) - 9)} | {("words", "nobody", "wrote")}

    def clean(t):
        w = WORD.findall(lower(t))
        return not any(tuple(w[k:k + n]) in windows for n in (3, 10) for k in range(len(w) - n + 1))

    want = {i: t for i, t in first.values() if clean(t)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(first) < len(left) < len(rows)
    for i, t in want.items():
        ids = lib.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark, sample())
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
