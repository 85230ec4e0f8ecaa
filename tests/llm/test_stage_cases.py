"""Every pipeline stage and what it calls on null and repeated doc_ids, clashing columns, repeated rows, long texts and empty tables."""

import corpus_pipeline
import pytest

from cellwise.llm import mixing, toxicity

CLASH = "size string, copies int, rows int, kept int, row int, digest string, each int, copy int, range int, place int"


def frame(spark, rows):
    rest = ("clash", 7, 1, 2, 3, "d", 4, 5, 6)
    return spark.createDataFrame([(*r, *rest, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + CLASH)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mix_by_row(spark):
    long = "w " * 200_000
    rows = [(1, "a b", "x"), (1, "c d e", "x"), (1, "a b", "x"), (None, "f g", "x"), (None, "f g", "x"), (None, "h", None), (2, None, "x"), (3, "", "y"), (4, "  ", None), (5, long, "y")]
    docs = frame(spark, rows * 3).repartition(3)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    found, given = rows_of(mixed), rows_of(docs)
    assert set(found) <= set(given) and all(found.count(r) <= 2 for r in set(found))
    counts = mixing.mix(docs).collect()
    assert len(found) == sum(r.copies for r in counts) and sum(len((r[1] or "").split()) for r in found) == sum(r.taken for r in counts)
    assert found == rows_of(mixing.mixed_documents(docs.repartition(5)))
    alike = [r for r in found if r[:3] == (1, "a b", "x")]  # copies of one row are dealt out evenly
    each = [alike.count(r) for r in given if r[:3] == (1, "a b", "x")]
    assert max(each) - min(each) <= 1
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_toxicity_by_row(spark):
    model = toxicity.Model({"vile": 20.0}, (8.0, 16.0))
    rows = [(1, "vile one", "x"), (1, "fine one", "x"), (None, "vile", "x"), (None, "fine", None), (2, None, "x"), (3, "", "x"), (4, "word " * 300_000 + "VILE!", "x"), (5, "word " * 300_000, "x")]
    docs = frame(spark, rows * 2).repartition(3)
    left = toxicity.drop_toxic(docs, model)
    assert left.schema == docs.schema
    assert rows_of(left) == sorted((tuple(r) for r in docs.collect() if "vile" not in (r.text or "").lower()), key=str)
    assert toxicity.drop_toxic(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_all_stages(spark, folder):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words number {i} and {i * i} of a short text {i}", "s" if i % 3 else None) for i in range(60)]
    rows += [(7, "kind words of a repeated id", "s"), (None, "kind words without an id", "s"), (None, None, None), (61, "", "s"), (61, "", "s"), (62, "kind " * 100_000, "t")]
    docs = frame(spark, rows).repartition(3)
    for part in (docs, docs.limit(0)):
        at = part
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, at, folder).cache()
            assert after.schema == docs.schema, name
            assert set(rows_of(after)) <= set(rows_of(at))
            at = after
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, folder).collect()
        assert sum(r.length for r in pieces) == sum(len(r.ids) for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
        assert sum(r.start == 0 for r in pieces) == at.count()
    kept = [r[:2] for r in rows_of(corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, folder), folder))]
    assert (7, "kind words of a repeated id") in kept and (None, "kind words without an id") in kept and not any("vile" in (t or "") for _, t in kept)
