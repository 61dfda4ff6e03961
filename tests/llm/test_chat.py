"""Roles of transcripts: exact round trip with markers, held-out accuracy without."""

import itertools
import random

import numpy as np

from memspark.llm import chat as C


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    counts = {("next", 1, 2): 9, ("next", 2, 1): 9, ("turns", 1, 0): 10, ("lines", 1, 0): 20, ("f0", 1, 2): 5, ("f0", 2, 4): 8}
    model = C.model_of(counts)
    for _ in range(20):
        lines = [rng.choice(["User: hi", "A: yes", "plain text?", "x" * 200, ""]) for _ in range(4)]
        marks = [C.marker(x) for x in lines]
        shows, none, other = C.CHANCES[marks[0][0] >= 0]

        def score(path):
            total = model.start[path[0]]
            for k, state in enumerate(path):
                role, begin = marks[k]
                total += model.move[path[k - 1], state] if k else 0
                if state < 3:
                    total += C._parts(none if role < 0 else shows if role == state else other)
                else:
                    total += C._parts(1 - 3 * C.LATER if role < 0 else C.LATER)
                total += sum(model.seen[f][state, v] for f, v in enumerate(C.look(lines[k][begin:])))
            return total

        best = max(score(p) for p in itertools.product(range(6), repeat=4))
        assert score(model.states(lines)[0]) == best


def test_round_trip(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    truth = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        truth.setdefault(r.conv_id, []).append((r.role, r.text.strip("\n")))
    got, style = {}, {}
    for r in C.format_conversations(turns).collect():
        got.setdefault(r.conv_id, {})[r.turn_no] = (r.role, r.content)
        style[r.conv_id] = r.style
        assert r.rendered == f"<|{r.role}|>\n{r.content}\n<|end|>\n"
    assert got.keys() == truth.keys()
    marked = [c for c in truth if style[c] < 4]
    assert marked and all([got[c][i] for i in range(len(got[c]))] == truth[c] for c in marked)
    plain = [c for c in truth if style[c] == 4]
    right = total = 0
    for c in plain:
        lines = lambda turns: [role for role, text in turns for line in text.split("\n") if line]
        a, b = lines(truth[c]), lines([got[c][i] for i in range(len(got[c]))])
        right += sum(x == y for x, y in zip(a, b))
        total += len(a)
    assert right / total > 0.6


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, 0, "user", "hi", 2), (1, 0, "user", "hi", 2), (1, 1, "robot", "", 3), (2, 70, "assistant", "x <|end|>", 4)]
    rows += [(3, 0, "user", f"q{i}", 5) for i in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    out = C.format_conversations(df).collect()
    assert {r.conv_id for r in out} == {None, 1, 2, 3}
    assert sorted(r.turn_no for r in out if r.conv_id == 3) == list(range(len([r for r in out if r.conv_id == 3])))
    assert sum(r.content.count("q") for r in out if r.conv_id == 3) == 1200
    assert any("x < |end|>" in r.rendered for r in out)
    assert C.format_conversations(df.limit(0)).count() == 0
    parsed = C.parse_transcripts(spark.createDataFrame([(1, None), (2, "User: a\nb\nAssistant: c"), (3, "")], "role int, text string"), C.model_of({}))
    assert [tuple(r)[1:3] for r in parsed.where("turn_no = 1").collect()] == [("assistant", "c")]


def test_pieces_are_parsed_as_one_transcript(spark):
    """Conversations of any length equal one Viterbi over all of their lines, however their pieces are put together."""
    rng = random.Random(4)
    says = ["is it so?", "Yes.", "- one\n- two", "", "A longer line of text that goes on for a while, and then some more of it.", "\n\nlate", "x <|y", "User: quoted", "hm"]
    sizes = {1: 1, 2: 64, 3: 65, 4: 128, 5: 129, 6: 513, 7: 5000, 8: 700, 9: 66, 10: 300}
    rows = [(c, i, ("user", "assistant")[i % 2] if i or c % 2 else "system", rng.choice(says)) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    pieces = C.segments(df)
    model = C.fit(pieces)
    lines, styles = {}, set()
    for r in C.transcripts(pieces).withColumn("style", C._style()).orderBy("conv", "piece").collect():
        lines.setdefault(r.conv, []).extend(r.text.split("\n"))
        styles.add(r.style)
    assert len(styles) > 2
    want = {conv: C.parse(found, model) for conv, found in lines.items()}
    for fan in (4, C.FAN):
        got = {}
        for r in C.parse_pieces(C.transcripts(pieces), model, fan).collect():
            assert r.turn_no not in got.setdefault(r.conv, {})
            got[r.conv][r.turn_no] = (r.role, r.content)
            assert r.rendered == C.render(r.role, r.content)
        assert {conv: [found.get(i) for i in range(len(found))] for conv, found in got.items()} == want
    # Blank lines say nothing of a role, so a turn may run over many pieces.
    blank = spark.createDataFrame([(1, i, "user", "") for i in range(300)], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(blank, 4).count() >= 1


def test_counts_run_over_the_cuts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {r.piece: (r.before, len(r.turns)) for r in C.segments(df).collect()}
    assert before == {0: (None, 64), 1: ("assistant", 64), 2: ("assistant", 64), 3: ("assistant", 8)}
    exact = C.segments(df.where("turn < 128")).collect()
    assert sorted(r.piece for r in exact) == [0, 1]
