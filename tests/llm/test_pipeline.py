import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm.mixing import WEIGHTS, mix_sources
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute_components, jaccard, shingles

SF = "/root/testdata/sf0.01"
INSULTS = "idiot|stupid|moron|scum|trash|loser|clown|pathetic|worthless|disgusting"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """What every stage kept of the smallest table, each stage reading the one before."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        f(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_and_columns(stored):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        assert stored[name].columns == stored["documents"].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, stored):
    left = {x.doc_id for x in stored["toxicity"].collect()}
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [i for i, t in labels.items() if i not in left]
    rude = {x.doc_id for x in stored["documents"].collect() if len(set(re.findall(INSULTS, x.text.lower()))) >= 3}
    assert len(rude & left) <= 0.1 * len(rude)
    assert sum(labels[i] == 0 for i in gone) <= 0.01 * len(labels)


@pytest.mark.parametrize("rows", [[], [(1, 1, None), (None, 1, 1), (77, 1, 1)]])
def test_without_usable_labels_all_documents_stay(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a clean text", "en", "src1", 12), (2, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage("toxicity")(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == [1, 2]


def test_near_duplicates_against_brute_force(stored):
    """Five-word shingles and a similarity of 0.8: of what is that alike one document stays, and whatever goes is like one that stays."""
    before = {x.doc_id: shingles(x.text) for x in stored["toxicity"].collect()}
    left = {x.doc_id for x in stored["near_duplicates"].collect()}
    alike = {(a, b): jaccard(before[a], before[b]) for a in before for b in before if a < b and before[a] & before[b] or a < b and before[a] == before[b]}
    both = [(a, b) for (a, b), j in alike.items() if j >= 0.8 and a in left and b in left]
    pairs = [p for p, j in alike.items() if j >= 0.8]
    assert len(pairs) > 50 and len(both) <= 0.02 * len(pairs) and not [p for p in both if alike[p] >= 0.9]
    ids = sorted(before)
    low = brute_components(ids, [p for p, j in alike.items() if j >= 0.65])
    assert {low[i] for i in ids} == {low[i] for i in left}
    near = {x for p, j in alike.items() if j >= 0.65 for x in p}
    assert left >= set(ids) - near


def test_decontamination_equals_brute_force(spark, stored):
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = set()
    for _, t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    want = []
    for x in stored["near_duplicates"].collect():
        w = words(x.text)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.append(x.doc_id)
    assert sorted(x.doc_id for x in stored["decontamination"].collect()) == sorted(want)


def test_the_mixture_is_the_stored_order_and_the_shards_are_its_ranges(stored):
    mixed = [x.doc_id for x in sorted(mix_sources(stored["decontamination"], WEIGHTS).collect(), key=lambda x: (x.mix_slot, x.mix_offset))]
    assert [x.doc_id for x in sorted(stored["sharding"].collect(), key=lambda x: (x.shard, x.slot))] == mixed
    sizes = [x["sum(size)"] for x in stored["sharding"].groupBy("shard").sum("size").collect()]
    longest = stored["sharding"].agg({"size": "max"}).first()[0]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * longest


def test_run_gives_the_last_stage(spark, stored):
    rows = lambda df: sorted((x.doc_id, x.shard, x.slot) for x in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stored["sharding"])


ODD = [
    (1, "a clean text of some words here", "en", "src1", 31, "x"),
    (1, "a clean text of some words here", "en", "src1", 31, "x"),
    (None, "a clean text of some words here", None, None, None, None),
    (2, None, None, None, None, None),
    (3, "", "en", "src2", 0, "y"),
    (None, None, "en", "src2", 0, "y"),
    (4, "another text that is like no other in this table", "de", "nowhere", 5, "z"),
    (5, "tie one two three four five six", "de", "src0", 5, "z"),
    (6, "long " * 50_000 + "end", "de", "src0", 5, "z"),
]


def odd(spark, extra=True):
    """Nulls, empty and long texts, rows and ids that repeat, and columns with the operators' own names."""
    names = ["mix_slot", "size", "__k", "fp", "score", "n_hit"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, note string")
    for n in names if extra else ():
        docs = docs.withColumn(n, F.col("note"))
    return docs


@pytest.mark.parametrize("name, left", [("toxicity", [1, 1, 2, 3, 4, 5, 6, None, None]), ("near_duplicates", [1, 2, 4, 5, 6]), ("decontamination", [1, 1, 2, 3, 4, 5, 6, None, None]), ("mixing", [1, 1, 2, 3, 4, 5, 6, None, None])])
def test_stages_on_odd_rows(spark, name, left):
    docs = odd(spark)
    got = stage(name)(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((x.doc_id for x in rows), key=lambda i: (i is None, i)) == left
    assert {tuple(x) for x in rows} <= {tuple(x) for x in docs.collect()}


def test_sharding_odd_rows(spark):
    docs = odd(spark, extra=False)
    got = stage("sharding")(spark, docs, SF)
    rows = got.collect()
    assert got.columns[: len(docs.columns)] == docs.columns and len(rows) == len(ODD)
    by_shard = {}
    for x in rows:
        by_shard.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shards_do_not_depend_on_how_rows_are_stored(spark, stored, tmp_path):
    stored["mixing"].repartition(5).write.option("maxRecordsPerFile", 40).parquet(f"file://{tmp_path}/again")
    place = lambda df: sorted((x.doc_id, x.shard, x.slot) for x in df.collect())
    assert place(stage("sharding")(spark, spark.read.parquet(f"file://{tmp_path}/again"), SF)) == place(stored["sharding"])


def test_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).count() == 0, name
