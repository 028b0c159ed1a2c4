"""Top-k search and chat formatting against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom.llm import chat_format, topk_search
from corpusloom.llm.queries import op3_chat_format, transcripts
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, id long, vec string, rank int, score double"


def vectors(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # equal vectors
    rows += [(5000, None), (5050, [1.0] * 7 + [None]), (5100, [1.0] * 7 + [float("nan")]), (None, [1.0] * 8), rows[7], (5150, [])]
    return rows, spark.createDataFrame([(*r, 1, "c", 2, 0.5) for r in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    valid = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    out = []
    for q in valid:
        if q % every == 0:
            best = sorted((-int(valid[q] @ x), i) for i, x in valid.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(400, 64), (3, 1024), (90, 8)])
def test_top_k(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rows, given = vectors(spark, n)
    assert sorted(map(tuple, topk_search.top_k(given, every=10).collect())) == brute(rows, 5, 10)


@pytest.mark.parametrize("size", [1.0, 1e6, 2.0**45, 1e300])
def test_top_k_of_large_components_and_repeated_ids(spark, size):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 120)), (rng.uniform(-1, 1, 6) * (size if k % 3 == 0 else 1)).tolist()) for k in range(240)]
    rows += [rows[0], (50, [0.5] * 6), (50, [-0.5] * 6)]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q in {i for i, _ in ints if i % 50 == 0}:
        best = sorted((max(1 - 10**38, min(10**38 - 1, -sum(a * b for a, b in zip(v, w, strict=True)))), j) for i, v in ints if i == q for j, w in ints if j != i)[:5]
        expected += [(q, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_scores_within_a_long_are_exact(spark):
    rows = [(0, [2.0**50, 1 / 256]), (1, [1 / 256, 0.0]), (2, [1 / 256, 1.0]), (50, [0.5, 0.25]), (3, [-(2.0**40), 3.0])]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    scores = {(r["query"], r["id"]): r["score"] for r in found}
    assert scores[(0, 1)] == 2**58 and scores[(0, 2)] == 2**58 + 256 and scores[(50, 3)] == -(2**48) * 128 + 3 * 256 * 64


def test_many_components(spark):
    """So many large components that doubles would round their sums."""
    wide = [4095.99] * 70000
    rows = [(0, wide), (1, [*wide[:-1], 4095.99 - 1 / 256]), (2, [1.0] * 70000)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n = math.floor(256 * 4095.99)
    assert [(r["id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, n * n * 69999 + n * (n - 1)), (2, 256 * n * 70000)]


def test_top_k_broadcasts_no_queries(spark, monkeypatch):
    """Blocks of queries are far larger than their file for each lot that they visit; none goes through the driver."""
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk_search, "LOT", 2)
    rows, given = vectors(spark, 400)
    found = topk_search.top_k(given, every=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 10)


def test_top_k_of_nothing(spark):
    _, given = vectors(spark, 3)
    assert topk_search.top_k(given.where("false")).count() == 0
    assert topk_search.top_k(given.where("vec_id = 0")).count() == 0


def brute_states(segments):
    """Viterbi over all lines of a conversation at once: the role of each line, and the last line of each segment."""
    best, back, ends = None, [], []
    for text in segments:
        lines = chat_format.split_lines(text)
        emit, _ = chat_format.emissions(lines)
        for i, e in enumerate(emit):
            step = chat_format.NEXT if i == 0 or chat_format.marker(lines[i])[0] >= 0 else chat_format.INSIDE
            score = (chat_format.START if best is None else best)[:, None] + step
            back.append(score.argmax(axis=0))
            best = score.max(axis=0) + e
        ends.append(len(back) - 1)
    state, states = int(best.argmax()), []
    for b in reversed(back):
        states.append(state)
        state = int(b[state])
    states.reverse()
    return states, ends


def brute_roles(segments):
    states, ends = brute_states(segments)
    return [chat_format.ROLES[states[e]] for e in ends]


def brute_turns(segments):
    """The rendered turns of each segment: lines of one role, and a new turn at each marker; blank turns go."""
    states, ends = brute_states(segments)
    out = []
    for text, end in zip(segments, ends, strict=True):
        turns = []
        lines = chat_format.split_lines(text)
        for line, state in zip(lines, states[end - len(lines) + 1 : end + 1], strict=True):
            named, rest = chat_format.marker(line)
            if named >= 0 or not turns or turns[-1][0] != state:
                turns.append((state, []))
            turns[-1][1].append(rest if named >= 0 else line)
        texts = [(chat_format.ROLES[s], "\n".join(parts).strip()) for s, parts in turns]
        out.append("".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in texts if t))
    return out


def test_registered_chat_query(spark):
    """Every row of the query: roles, number of turns and the rendered text's digest, conversation by conversation."""
    talks = {}
    for r in transcripts(spark.read.parquet(f"{DATA}/conversations.parquet")).collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"] if r["turn"] is not None else -1, r["raw"]))
    found = {}
    for r in op3_chat_format(spark, DATA).collect():
        found.setdefault(r["conv_id"], []).append((r["turn"] if r["turn"] is not None else -1, r["role_found"], r["n_turns"], r["rendered_sha256"]))
    assert found.keys() == talks.keys()
    for conv, rows in talks.items():
        rows.sort()
        texts = [t for _, t in rows]
        rendered = brute_turns(texts)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in rendered]
        expected = zip((t for t, _ in rows), brute_roles(texts), (t.count("<|end|>\n") for t in rendered), sha, strict=True)
        assert sorted(found[conv]) == sorted(expected)


def way_score(texts, roles):
    """The log chance of the best way that ends each segment in the role given."""
    total, before = 0.0, None
    for text, role in zip(texts, map(chat_format.ROLES.index, roles), strict=True):
        m = chat_format.transfer(chat_format.split_lines(text))
        total += float((chat_format.START[:, None] + m)[:, role].max() if before is None else m[before, role])
        before = role
    return total


def test_tree_over_the_chunks(spark, monkeypatch):
    """A conversation of many levels, without a group of more than a few parts."""
    monkeypatch.setattr(chat_format, "FAN", 3)
    rng = np.random.default_rng(9)
    heads = ["User: ", "AI: ", "", "", "", "System: "]
    talks = {c: [heads[rng.integers(len(heads))] + "\n".join(rng.choice(["why?", "- item", "plain words", ""]) for _ in range(rng.integers(1, 3))) for _ in range(n)] for c, n in ((1, 130), (None, 61), (2, 5), (3, 18))}
    rows = [(c, t, x) for c, texts in talks.items() for t, x in enumerate(texts)]
    found = chat_format.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4), chunk=2).collect()
    assert len(found) == len(rows)
    for c, texts in talks.items():
        mine = [r["role"] for r in sorted((r for r in found if r["conv"] == c), key=lambda r: r["pos"])]
        # of equally likely ways another may be taken, as sums are rounded in another order
        assert abs(way_score(texts, mine) - way_score(texts, brute_roles(texts))) < 1e-9

def test_chat(spark):
    rng = np.random.default_rng(4)
    heads = ["User: ", "Assistant:\n", "### System:\n", "<|user|>\n", "Human: ", "AI: ", "", "", "Q: "]
    talks = {c: [heads[rng.integers(len(heads))] + "\n".join(rng.choice(["why?", "- item", "plain words", "A: said", ""]) for _ in range(rng.integers(1, 4))) for _ in range(n)] for c, n in ((1, 40), (2, 1), (3, 7), (None, 5))}
    rows = [(c, t, x, "r", "x", 1) for c, texts in talks.items() for t, x in enumerate(texts)]
    rows += [(4, None, None, "r", "x", 1), (4, 0, "", "r", "x", 1), (4, 1, "User: hi", "r", "x", 1), (4, 1, "User: hi", "r", "x", 1)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, m string, chunk int").repartition(3)
    for chunk in (3, 256):
        found = chat_format.parse(given, chunk=chunk).collect()
        assert len(found) == len(rows)
        for c, texts in talks.items():
            roles = [r["role"] for r in sorted((r for r in found if r["conv"] == c), key=lambda r: r["pos"])]
            assert roles == brute_roles(texts)
    turns = chat_format.parse(spark.createDataFrame([(1, 0, "User: hi\nthere"), (1, 1, "hello back")], "conv_id long, turn long, text string")).orderBy("pos").collect()
    assert [[tuple(t) for t in r["turns"]] for r in turns] == [[("user", "hi\nthere")], [("assistant", "hello back")]]
    assert turns[0]["rendered"] == "<|user|>\nhi\nthere\n<|end|>\n"
    assert chat_format.parse(given.where("false")).count() == 0


def test_one_text_of_several_turns(spark):
    said = [("system", "be brief"), ("user", "what is a loom?\nand a shuttle?"), ("assistant", "- a frame\n- a boat"), ("user", "thanks")]
    heads = [lambda r: f"{r.capitalize()}: ", lambda r: f"<|{r}|>\n", lambda r: f"### {r.capitalize()}:\n"]
    rows = [(k, 0, "\n".join(head(r) + t for r, t in said)) for k, head in enumerate(heads)]
    found = chat_format.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert all([tuple(t) for t in r["turns"]] == said for r in found)


def test_unmarked_turns(spark):
    """Of turns without a speaker's name most are found by what stands around them."""
    given = transcripts(spark.read.parquet(f"{DATA}/conversations.parquet").where("role is not null and conv_id is not null"))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    truth = given.select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.col("role").alias("said"), bare.alias("bare"))
    found = chat_format.parse(given, text_col="raw").join(truth, ["conv", "pos"])
    right = {r["bare"]: r["right"] for r in found.groupBy("bare").agg(F.avg((F.col("role") == F.col("said")).cast("int")).alias("right")).collect()}
    assert right[False] > 0.98 and right[True] > 0.85


def test_chat_chunks_stay_small_without_positions(spark):
    talks = {None: [(i % 8, f"User: {i}" if i % 3 else f"why {i}?") for i in range(120)], 1: [(None, "hi")] * 50, 2: [(i, f"AI: {i}") for i in range(9)]}
    rows = [(c, t, x) for c, turns in talks.items() for t, x in turns]
    given = spark.createDataFrame(rows, "conv long, pos long, text string").repartition(3)
    assert chat_format.deal(given, 16).groupBy("conv", "chunk").count().agg(F.max("count")).first()[0] <= 16
    found = chat_format.parse(given, "conv", "pos", "text", chunk=16).collect()
    for c, turns in talks.items():
        order = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        # equal rows of one position are told apart by the role alone
        expected = Counter(zip((t for t, _ in order), brute_roles([x for _, x in order]), strict=True))
        assert Counter((r["pos"], r["role"]) for r in found if r["conv"] == c) == expected
