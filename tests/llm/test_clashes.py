import pytest

from pairwright.llm.decontaminate import decontaminate, find_matches
from pairwright.llm.mixing import mix_sources, mixed
from pairwright.llm.pii import find_pii, redact, trained
from pairwright.llm.sharding import shard_documents
from pairwright.llm.simhash import dedupe
from pairwright.llm.tokens import VOCABULARY, count_tokens
from pairwright.llm.toxicity import Model, score_toxicity

NAMES = ["__k", "__g", "__m", "__p", "__i", "__h", "__n", "__id", "__key", "__pii", "__cell", "__before", "fp", "score", "SHARD", "Mix_Slot", "n_hit", "spans", "a", "b", "n", "top", "lead"]


@pytest.fixture()
def docs(spark):
    rows = [(1, "one two three four a@b.co", "src0", *range(len(NAMES))), (1, "one two three four a@b.co", "src0", *range(len(NAMES))), (2, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES))


def test_columns_of_any_name(spark, docs):
    import numpy as np
    import public_tokenizers

    items = spark.createDataFrame([(1, "two three four", "x", 1)], "item_id long, text string, fp string, __m int")
    model = Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    for out in (dedupe(docs), mixed(docs, {"src0": 1}), decontaminate(docs, items), redact(docs)):
        assert out.columns == docs.columns
        own = {tuple(x[n] for n in NAMES) for x in docs.collect()}
        assert {tuple(x[n] for n in NAMES) for x in out.collect()} <= own
    assert dedupe(docs).count() == 2 and decontaminate(docs, items).count() == 1
    for out in (mix_sources(docs, {"src0": 1}), shard_documents(docs, 4), find_matches(docs, items), find_pii(docs, model=trained()), count_tokens(docs, public_tokenizers.path(VOCABULARY)), score_toxicity(docs, model)):
        rows = out.collect()
        low = [c.lower() for c in out.columns]
        assert len(rows) == 3 and len(set(low)) == len(low)
        kept = {"__k", "__p", "__pii", "a", "lead"} & set(out.columns)
        assert kept == {"__k", "__p", "__pii", "a", "lead"}
        assert all(x["__k"] == (0 if x.doc_id == 1 else None) for x in rows)
