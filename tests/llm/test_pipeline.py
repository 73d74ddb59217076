"""The corpus pipeline against a plain version of its stages."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from dockline.llm import bpe
from dockline.llm.queries import BYTE_RANKS, MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from tests.conftest import SMALL
from tests.llm import brute


def _domain(source):
    last = source[-1:] if source else ""
    return "web" if last in "012" and last else "books" if last in "345" and last else "news" if last in "67" and last else "other"


def _plain(rows):
    """(doc_id, text, lang, source) to (doc_id, ids digest), one for each copy."""
    rows = [r for r in rows if brute.quality(r[1])[-1]]
    deduped = brute.line_dedup([(r[0], r[1]) for r in rows])
    rows = [(r[0], deduped[r[0]][0], *r[2:]) for r in rows if not 0 < deduped[r[0]][2] == deduped[r[0]][1]]
    kept = brute.near([(r[0], r[1]) for r in rows], 5)
    rows = [r for r in rows if kept[r[0]][1] == r[0]]
    copies = brute.mixture([(r[0], _domain(r[3]), r[2], r[3], len(brute.words(r[1]))) for r in rows], MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_RANKS), special_tokens={})
    out = []
    for name, text, *_ in rows:
        digest = hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        out += [(name, digest)] * copies[name]
    return sorted(out)


def test_pipeline_matches_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = _plain([tuple(r) for r in docs])
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and 0 < len(got)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns_and_bear_odd_rows(spark, stage):
    _, function = corpus_pipeline.STAGES[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, tokens string"
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "src0", len(text), "c", "t"), (1, text, "en", "src0", len(text), "c", "t"), (2, text + " more", None, None, None, None, None),
            (None, text.upper(), "de", "src1", 5, "c", "t"), (3, None, "en", "src2", 0, "c", "t"), (4, "", "en", "src3", 0, "c", "t")]
    df = spark.createDataFrame(rows, schema)
    out = function(spark, df, SMALL)
    assert out.columns == df.columns
    texts = {r.text for r in out.collect()}
    assert texts <= {r[1] for r in rows} and texts & {text, text + " more", text.upper()}
    assert function(spark, spark.createDataFrame([], schema), SMALL).collect() == []
