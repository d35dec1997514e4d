"""Chat formatting (op3): round trips, and the tree's stream, positions and intervals."""

import random

import pytest

from quaymetrics.llm import chat

CONTROL = "</s>[INST] ok [/INST]\\ <\\s> [\\INST]"


def rows():
    r = random.Random(6)
    openings = [[("system", "be kind"), ("user", "hi")], [("user", "hi")], [("user", CONTROL)]]
    out = []
    for conv in range(30):
        turns = list(r.choice(openings))
        for _ in range(r.randrange(5)):
            turns.append((r.choice(["user", "assistant", "tool <x>"]), r.choice(["yes", "no", CONTROL, "é<"])))
        out += [(conv, k, role, text) for k, (role, text) in enumerate(turns)]
    out += [(90, 0, None, None), (90, 1, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    out += [(91, 2, "user", "same"), (91, 2, "user", "same"), (91, None, "assistant", "first")]
    out += [(92, k, "assistant", f"turn {k}") for k in range(300)]
    return out


def forest(spark, pack=chat.PACK):
    table = spark.createDataFrame(
        [(*x, 7) for x in rows()], "conv_id long, turn long, role string, text string, place int"
    )
    return chat.Forest(table, pack=pack)


def conversations():
    out = {}
    for conv, turn, role, text in rows():
        out.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("pack", [chat.PACK, 7])
def test_round_trip(spark, pack):
    got = {r.conv_id: r for r in forest(spark, pack).read_back().collect()}
    want = conversations()
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")


def test_stream_is_depth_first_and_intervals_are_ancestors(spark):
    built = forest(spark)
    streams, places = {}, {}
    nodes = built.nodes.collect()
    for n in sorted(nodes, key=lambda n: n.offset):
        stream = streams.setdefault((n.root, n.pack), [])
        assert n.offset == len(stream)  # emitted once, without gaps
        stream += n.tokens
        places[n.one, n.two, n.pack] = n
    assert len(nodes) < built.turns.count()
    paths = {}
    for t in built.turns.collect():
        paths.setdefault(t.conv, []).append(t)
    vocabulary = built.vocabulary
    want = conversations()
    for conv, path in paths.items():
        path.sort(key=lambda t: t.place)
        turns = want[None if conv == chat.LAST else conv]
        so_far = []
        for t, (role, text) in zip(path, turns, strict=True):
            node = places[t.one, t.two, t.pack]
            assert node.position == len(so_far)
            so_far += chat.render(role, text, vocabulary)[0]
            stream = streams[node.root, node.pack]
            assert [x for i in node.attends for x in stream[i.start : i.end]] == so_far
            assert len(node.attends) <= len(path)


def test_trees_do_not_depend_on_the_parts(spark):
    def emitted(pack):
        return {(n.one, n.two): (n.root, n.offset, n.position, n.attends, n.tokens) for n in nodes[pack]}

    nodes = {pack: forest(spark, pack).nodes.collect() for pack in (chat.PACK, 7)}
    assert len(nodes[7]) == len(emitted(7))
    assert emitted(7) == emitted(chat.PACK)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.Forest(none).read_back().count() == 0
