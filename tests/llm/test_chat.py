import hashlib
import random

import test_packing as packed
from hypothesis import given
from hypothesis import strategies as st

from orrery.llm import chat

ODD = st.lists(st.sampled_from([*"<>|[]\\/s rolexndtINSTYé\n", "<|role|>", "[INST]", "</s>", "<\\|end|>", "<<SYS>>"]), max_size=30).map("".join)


@given(ODD, ODD)
def test_turns_come_back_and_hold_no_control_strings(role, text):
    turn = chat.write(role, text)
    assert chat.read(turn) == (role, text)
    inside = chat.escape(text)
    assert not any(c in inside for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        sha = hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        out.append((c, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.write(t[2], t[3])) for t in turns)))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def run(spark, rows, most=chat.HOT_MEMBERS):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, start int, path string")
    paths, members = chat.format_conversations(spark, df)
    found = chat.of_members(spark, members, chat.read_back(spark, paths), most).select(COLUMNS).collect()
    return sorted((tuple(r) for r in found), key=str), paths.collect()


def check_tree(paths):
    """The stream is gapless, each node stands in it once, positions follow the ancestors, and the merged intervals that a
    turn attends to hold its ancestors' tokens and no others."""
    nodes, stream = {}, {}
    for p in paths:
        ids = [bytes(p.path)[: 16 * (i + 1)] for i in range(len(p.starts))]
        for i, (node, start, length) in enumerate(zip(ids, p.starts, p.lengths)):
            assert nodes.setdefault(node, (start, length)) == (start, length)
            assert not i or start >= p.starts[i - 1] + p.lengths[i - 1]
        for i, t in enumerate(p.emitted, p.shared):
            assert t.start == p.starts[i] and len(t.tokens) == p.lengths[i]
            begin = sum(p.lengths[:i])
            assert list(t.position_ids) == list(range(begin, begin + len(t.tokens)))
            spans = [(a.start, a.end) for a in t.attends]
            assert all(x[1] < y[0] for x, y in zip(spans[:-1], spans[1:]))
            own = [x for s, n in zip(p.starts[:i], p.lengths[:i]) for x in range(s, s + n)]
            assert [x for a, z in spans for x in range(a, z)] == own
            assert not set(range(t.start, t.start + len(t.tokens))) & set(stream)
            stream.update(zip(range(t.start, t.start + len(t.tokens)), t.tokens))
    assert sorted(stream) == list(range(len(stream))) == list(range(sum(n for _, n in nodes.values())))
    tokenizer = packed.tokenizer()
    for p in paths:  # every conversation can be read by attention alone, and its tokens are those of the vocabulary
        leaf = p.emitted[-1] if p.emitted else None
        text = tokenizer.decode([stream[x] for a in leaf.attends for x in range(a.start, a.end)] + list(leaf.tokens), skip_special_tokens=False)
        turns = [chat.read(t + chat.END) for t in text.split(chat.END)[:-1]]
        assert len(turns) == len(p.starts) and [r == "assistant" for r, _ in turns] == list(p.loss)


def test_shared_turns(spark):
    rnd, rows = random.Random(5), []
    for c in range(150):
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant"][t % 2], "hello" if not t and c % 3 else rnd.choice("abcé") * rnd.randrange(0, 3)))
    got, paths = run(spark, rows)
    assert got == brute(rows) and len(paths) < 150
    check_tree(paths)
    assert run(spark, rows, most=2)[0] == got


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert sorted((tuple(r) for r in chat.op3_chat_prefix_tree(spark, sf).select(COLUMNS).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "x"), (2, 0, "", ""), (3, 0, "us\ner", "<|end|>"), (3, 0, "us\ner", "<|end|>"), (4, 0, "assistant", "y " * 50000), (None, 1, "user", "z")]
    got, paths = run(spark, rows)
    assert got == brute(rows)
    check_tree(paths)
    assert run(spark, []) == ([], [])
