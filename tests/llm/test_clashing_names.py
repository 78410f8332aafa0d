"""Extra columns named like any helper column, in lower and upper case, break no operator that carries or ignores them."""

import public_tokenizers
import pytest

import corpus_pipeline
from quillmesh.llm import decontaminate, exact_dedup, ngram_join, packing, spelling, substring_dedup, toxicity

HELPERS = (
    "__h __id __k __key __key1 __key2 __spans __n __t __all h id k key n t norm rows row size slot bucket depth owner chain chained bytes keep_id group_size text_sha256 count "
    "token df room rep root links lead tile side band chunk fp prefix first common docs node a b text_key s spans items stop start block grp x kept TEXT DOC_ID Text"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(words[:58])), (3, " ".join(words[:58])), (None, None), (5, ""), (6, "short text"), (7, "another longer text that says something else " * 3)]
    kind = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in HELPERS)
    return spark.createDataFrame([(i, t, *[f"{n}!" for n in HELPERS]) for i, t in rows], kind)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", " ".join(f"w{i}" for i in range(40, 55)), "x", "y")], "item_id string, text string, TEXT string, block string")


def carried(got, docs):
    """All columns are there, and those beside the text are as they were."""
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(tuple(r)[2:] == tuple(f"{n}!" for n in HELPERS) for r in rows)
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_rows_are_carried(spark, docs, bench):
    of = lambda ids: sorted(((r[0], r[1]) for r in docs.collect() if r[0] in ids), key=str)
    assert len(carried(exact_dedup.exact_dedup(docs), docs)) == 5
    assert len(carried(exact_dedup.exact_dedup(docs, hash_bits=2), docs)) == 5
    kept = carried(ngram_join.keep_one(docs), docs)
    assert [i for i, _ in kept] == [1, 5, 6, 7, None]
    for words in (200_000, 3):
        got = dict(carried(decontaminate.decontaminate(docs, bench.union(bench), block_words=words), docs))
        assert got[1].split() == [f"w{i}" for i in (*range(40), *range(55, 60))] and got[6] == "short text"
    assert [i for i, _ in carried(substring_dedup.remove_repeats(docs), docs)] == sorted([1, 2, 3, 3, 5, 6, 7, None], key=str)
    labels = spark.createDataFrame([(1, 1, "x"), (7, 0, "y")], "doc_id long, toxic int, TOXIC string")
    model = toxicity.fit(docs, labels)
    assert carried(toxicity.drop_toxic(docs, model, threshold=2.0), docs) == of([1, 2, 3, 5, 6, 7, None])


def test_rows_are_ignored(spark, docs, bench):
    assert exact_dedup.exact_groups(docs).count() == 8
    assert ngram_join.near_groups(docs).count() == 8
    assert decontaminate.matches(docs, bench).count() == 8
    assert substring_dedup.repeats(docs).count() == 8
    assert spelling.count_words(docs, least=1).count() == 3  # another, longer, something
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() >= 8


def test_pipeline(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n in HELPERS if n.lower() not in ("text", "doc_id")]  # Parquet readers take such names for the same
    more = given.limit(40).selectExpr("*", *[f"'{n}!' AS `{n}`" for n in names])
    at = more
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert name == "packing" or at.columns == more.columns
    assert at.count() > 0
