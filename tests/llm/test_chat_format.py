import random

from pressgrid.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, chunk long, one string"


def brute(rows):
    chats = {}
    for conv, turn, role, text in sorted(set(rows), key=lambda r: tuple((x is not None, x) for x in r)):
        chats.setdefault(conv, []).append((role, text))
    out = []
    for conv, said in chats.items():
        longer = any(len(o) > len(said) and o[: len(said)] == said for o in chats.values())
        copies = [c for c, o in chats.items() if o == said]
        smallest = min((c for c in copies if c is not None), default=None)
        if not longer and conv == smallest:
            marked = [f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in said]
            out += [(conv, k // 64, len(said), len(copies), "".join(marked[k : k + 64])) for k in range(0, len(said), 64)]
    return sorted(out, key=repr)


def result(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, chat_format.format_chats(frame).collect()), key=repr)


def test_snapshots_collapse(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(40):
        source, length = rng.randrange(6), rng.randint(1, 6)
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", f"say {source} {k if rng.random() < 0.9 else 'x'}") for k in range(length)]
    assert result(spark, rows) == brute(rows)


def test_awkward(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"), (3, None, "user", "hi"), (None, 5, None, "hi")]
    rows += [(4, 0, "user", ""), (4, 0, "assistant", ""), (5, 0, None, "user"), (6, 0, "user", None), (None, 6, "", "hi")]
    assert result(spark, rows) == brute(rows)
    assert chat_format.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_are_cut_in_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(-300, 700)] + [(2, k, "user", f"t{k}") for k in range(-300, 500)]
    rows += [(3, 10 * k, "user", f"t{k - 300}") for k in range(1000)]  # the same turns under other numbers
    assert result(spark, rows) == brute(rows)
