import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, part int, rendered string"


def some_model(seed=0):
    rng = random.Random(seed)
    n = lambda k: rng.randint(0, k)
    turns = {(a, b): n(50) for a in chat.ROLES for b in chat.ROLES}
    lines = {(s, m, b, o): n(20) for s in range(6) for m in range(4) for b in range(2) for o in range(2)} if seed % 2 else None
    return chat.model_of({r: n(9) for r in chat.ROLES}, turns, {r: n(9) for r in chat.ROLES}, {(r, k): n(30) for r in chat.ROLES for k in range(28)}, lines)


def path_score(model, lines, path):
    forced, free = chat.steps(model)
    total = model.start[path[0]] if path[0] < 3 else -np.inf
    for i, (line, s) in enumerate(zip(lines, path)):
        total += chat.emission(model, line)[s] + (0 if i == 0 else (forced if line.forced else free)[path[i - 1], s])
    return total + model.stop[path[-1] % 3]


def test_viterbi_against_all_paths():
    for seed in range(4):
        model = some_model(seed)
        lines = chat.lines_of("Hi there\nUser: x\n\nA long line of words, and words") + chat.lines_of("- item")
        best = max(path_score(model, lines, p) for p in itertools.product(range(6), repeat=len(lines)))
        assert path_score(model, lines, chat.viterbi(model, lines)) == pytest.approx(best)
        # cut in two at any place, with the tables of both parts
        for cut in range(1, len(lines)):
            both = (chat.transfer(model, lines[:cut])[6][:, None] + chat.transfer(model, lines[cut:])[:6]).max(0)
            assert (both + np.tile(model.stop, 2)).max() == pytest.approx(best)


def test_markers():
    for line, role, rest in [("User: hi", 1, "hi"), ("### Assistant:\tyes", 2, "yes"), ("**Human:** a", 1, "a"), ("<|system|>be", 0, "be"), ("[AI]: b", 2, "b"), ("Q: why", 1, "why")]:
        assert chat.marker_of(line) == (role, rest)
    for line in ("Users: hi", "I ask: b", "user hi", "", "http://a", "Note: x"):
        assert chat.marker_of(line) == (3, line)


def test_a_marked_transcript_becomes_turns(spark):
    text = "System: Be brief.\nUser: What is it?\nIt has two lines.\nAssistant: A thing.\n- one\n- two\n\nUser: Thanks <|im_end|>\nAI: ok"
    docs = spark.createDataFrame([(1, 0, None, text, 1, "x")], SCHEMA)
    model = some_model()
    model.turn = np.log(np.array([[0.05, 0.9, 0.05], [0.02, 0.1, 0.8], [0.02, 0.8, 0.1]]))
    got = [tuple(r)[2:] for r in chat.recover(docs, model).orderBy("part").collect()]
    wanted = [("system", "Be brief."), ("user", "What is it?\nIt has two lines."), ("assistant", "A thing.\n- one\n- two"), ("user", "Thanks <|im_end|>"), ("assistant", "ok")]
    assert got == [(i, r, c, chat.render(r, c)) for i, (r, c) in enumerate(wanted)]
    assert got[3][3] == "<|im_start|>user\nThanks <| im_end|><|im_end|>\n"


def test_a_long_conversation_is_decoded_as_one(spark):
    rng = random.Random(2)
    rows = [(7, i, None, "\n".join(" ".join(["word"] * rng.randint(1, 80)) for _ in range(rng.randint(1, 4))), 1, "x") for i in range(600)]
    rows += [(8, i, None, "short", 1, "x") for i in range(3)] + [(None, 0, None, None, 1, "x"), (None, None, None, " \n ", 1, "x"), (9, 1, None, "same", 1, "x"), (9, 1, None, "same", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = some_model(3)
    found = chat.recover(docs, model).orderBy("conv_id", "turn", "part").toPandas()
    for conv, some in pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "part", "x"]).groupby("conv_id", dropna=False):
        some = some.sort_values("turn", na_position="first")
        lines = [line for t in some["text"] for line in chat.lines_of(t)]
        roles = [chat.ROLES[s] for s in chat.viterbi(model, lines) if s < 3]
        mine = found[found.conv_id.isna()] if pd.isna(conv) else found[found.conv_id == conv]
        assert mine["role"].tolist() == roles
    assert chat.recover(docs.limit(0), model).count() == 0


def test_roles_of_held_out_conversations(spark):
    every = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(every.where("conv_id % 2 = 0"))
    held = every.where("conv_id % 2 = 1")
    found = chat.recover(held, model).where("part = 0").withColumnRenamed("role", "found").join(held, ["conv_id", "turn"])
    right = found.agg(F.avg((F.col("found") == F.col("role")).cast("int"))).first()[0]
    assert right > 0.85


def test_emissions_are_counted(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], ("Question: how?" if t % 2 == 0 else "Well.\n\n- one\n- two") if c % 2 else "plain\nlines", 1, "x") for c in range(40) for t in range(4)]
    model = chat.fit(spark.createDataFrame(rows + [(1, 9, "tool", "- x", 1, "x"), (1, 10, None, None, 1, "x")], SCHEMA))
    n = 80
    assert np.exp(model.bullets[5, 1]) == pytest.approx((40 * 0.2 + n // 2 * 2) / (40 + n // 2 * 2 + n // 2))
    assert np.exp(model.bullets[1, 1]) == pytest.approx(40 * 0.05 / (40 + n))
    assert np.exp(model.opens[4, 1]) == pytest.approx(40 * 0.1 / (40 + n // 2))
    assert np.exp(model.marks[1, :3]) == pytest.approx(0.49 * np.array([0.8, 40 + n // 2, 0.8]) / (41.6 + n // 2))
    none = chat.fit(spark.createDataFrame([], SCHEMA))
    for a, b in zip((none.marks, none.bullets, none.opens), (chat.model_of({}, {}, {}, {}).marks, chat.model_of({}, {}, {}, {}).bullets, chat.model_of({}, {}, {}, {}).opens)):
        assert (a == b).all()


def test_the_query_against_brute_force(spark):
    """Every given conversation by one Viterbi over all its lines, under the model of the other fold; roles right in at least nine of ten turns."""
    sf = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{sf}/conversations.parquet")
    fold = F.pmod(F.xxhash64("conv_id", F.lit(13)), F.lit(2))
    models = [chat.fit(every.where(fold != k)) for k in range(2)]
    wanted, right, turns = [], 0, 0
    for (conv, k), rows in every.withColumn("k", fold).toPandas().groupby(["conv_id", "k"]):
        rows = rows.sort_values(["turn", "text"])
        split = [chat.lines_of(t) for t in rows["text"]]
        path = iter(chat.viterbi(models[k], [line for lines in split for line in lines]))
        for turn, role, lines in zip(rows["turn"], rows["role"], split):
            parts = []
            for line in lines:
                state = next(path)
                if state < 3:
                    parts.append([chat.ROLES[state]])
                parts[-1].append(line.text)
            wanted += [(conv, turn, i, r, "\n".join(text).strip()) for i, (r, *text) in enumerate(parts)]
            right, turns = right + (parts[0][0] == role.lower()), turns + 1
    found = queries.QUERIES["op1_chat_viterbi"](spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(wanted) and all(r.rendered == chat.render(r.role, r.content) for r in found)
    assert right >= 0.9 * turns


def test_repeated_rows_do_not_multiply(spark):
    """A conversation that comes three times counts three times, and a turn that comes very often meets no row of the next one by one."""
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")]
    schema = "conv_id long, turn long, role string, text string"
    once, thrice = (chat.fit(spark.createDataFrame(turns * n, schema)) for n in (1, 3))
    apart = chat.fit(spark.createDataFrame([(k, t, r, x) for k in range(3) for _, t, r, x in turns], schema))
    assert np.allclose(thrice.start, apart.start) and all(np.allclose(a, b) for a, b in zip(chat.steps(thrice), chat.steps(apart)))
    assert not np.allclose(once.start, apart.start)
    hot = spark.range(100_000).selectExpr("1L AS conv_id", "id % 2 AS turn", "'user' AS role", "'x' AS text")
    assert np.isfinite(chat.fit(hot).start).all()
