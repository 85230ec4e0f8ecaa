"""The pipeline and each stage against plain versions on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest

from cellwise.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    texts = {i: rng.choices(words, k=rng.randint(40, 200)) for i in range(400)}
    for i in range(0, 400, 8):  # toxic
        for _ in range(4):
            texts[i].insert(rng.randrange(len(texts[i])), rng.choice(["vile", "nasty", "foul"]))
    for i in range(300, 330):  # exact copies of clean ones
        texts[i] = list(texts[i - 299 if (i - 299) % 8 else 9])
    for i in range(330, 360):  # near copies
        texts[i] = list(texts[i - 229 if (i - 229) % 8 else 105])
        texts[i][5] = "changed"
    texts = {i: " ".join(t) for i, t in texts.items()} | {400: "", 401: None}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(any(w in (t or "").split() for w in ("vile", "nasty", "foul")))) for i, t in texts.items() if i % 2 == 0], "doc_id long, quality int, toxic int")
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_stages(spark, corpus):
    folder, texts = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "source_mix", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        if k < 3:
            assert docs.columns == COLUMNS
            seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    toxic = {i for i, t in texts.items() if set((t or "").split()) & {"vile", "nasty", "foul"}}
    assert seen[0] == sorted(set(texts) - toxic)
    sets = {i: {tuple((texts[i] or "").split()[k : k + 5]) for k in range(max(1, len((texts[i] or "").split()) - 4))} for i in seen[0]}
    kept = []
    for i in seen[0]:
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    assert seen[1] == kept and len(kept) < len(seen[0]) - 40
    assert set(seen[2]) <= set(kept) and all(seen[2].count(i) <= 2 for i in kept)
    words = sum(len((texts[i] or "").split()) for i in kept)
    assert abs(sum(len((texts[i] or "").split()) for i in seen[2]) - 1.5 * words) <= 5 * 200
    ids = packing.tokenizer()
    tokens = sum(len(ids(texts[i])) + 1 if texts[i] else 1 for i in seen[2])
    assert docs.agg({"length": "sum"}).first()[0] == tokens


def test_run_agrees_with_itself(spark, corpus):
    folder, _ = corpus
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert sum(r[2] for r in first) == sum(r[2] for r in again) > 0
    assert {r[0] for r in first} == {r[0] for r in again}
