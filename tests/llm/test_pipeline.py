"""The pipeline stage by stage next to plain readings of it, on given documents and awkward rows."""

import collections

import corpus_pipeline as P
import pytest
from test_near_dedup import brute

from urlrisk.llm import mixture
from urlrisk.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(None, "Nobody knows this one, it has no number at all.", None, None, None), (9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "12 34 !!", None, "src2", 8),
             (9004, "The one that stands here twice and is the same in both of its rows.", None, "src3", 9), (9004, "The one that stands here twice and is the same in both of its rows.", None, "src3", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), f"test-{name}"))
    return [(df.columns, [r.asDict() for r in df.collect()]) for df in out]


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixture", "shards"]
    assert all(columns == list(P.COLUMNS) for columns, _ in stages[:-1])


def test_language_keeps_every_text_with_a_letter(stages):
    (_, before), (_, after) = stages[:2]
    want = collections.Counter((r["doc_id"], r["text"]) for r in before if any(c.isalpha() for c in r["text"] or ""))
    assert collections.Counter((r["doc_id"], r["text"]) for r in after) == want
    assert all(r["lang"] for r in after)


def test_one_of_each_class_stays(stages):
    (_, before), (_, after) = stages[1:3]
    classes = brute([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    want = sorted(set(classes.values())) + [None]
    assert sorted((r["doc_id"] for r in after), key=lambda i: (i is None, i)) == want


def test_contaminated_documents_go(spark, stages):
    from urlrisk.llm.decontaminate import Items
    from urlrisk.llm.words import Hasher
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    (_, before), (_, after) = stages[2:4]
    hasher, made = Hasher(), Items(items)
    want = {r["doc_id"] for r in before if not made.contaminating(hasher.words(r["text"]), 0.5)}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want) < len(before)
    assert not [r for r in after for _, t in items if t in r["text"]]


def test_mixture_repeats_documents(spark, stages):
    (_, before), (_, after) = stages[3:5]
    docs = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    times = {r["row"]["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in mixture.take(docs).collect()}
    assert collections.Counter(r["doc_id"] for r in after) == collections.Counter({i: n for i, n in times.items() if n})
    assert max(times.values()) <= 3


def test_shards_hold_all_rows(stages):
    (_, before), (columns, after) = stages[4:6]
    assert columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert collections.Counter(r["doc_id"] for r in before) == collections.Counter(r["doc_id"] for r in after)
    slots = collections.defaultdict(list)
    for r in after:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
