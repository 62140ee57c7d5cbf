from chronotile.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, n long"


def conv(spark, data):
    return spark.createDataFrame([(c, t, r, x, "p", 1) for c, t, r, x in data], SCHEMA)


def test_collapse_and_render(spark):
    base = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    longer = [(2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more")]
    other = [(3, 0, "user", "hi"), (3, 1, "assistant", "no")]
    repeat = [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no")]
    odd = [(None, 0, "user", "lost"), (5, None, None, None), (6, 7, "user", "")]
    out = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render_chats(conv(spark, base + longer + other + repeat + odd)).collect()}
    assert set(out) == {2, 3, 5, 6}
    assert out[3] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n")
    assert out[5] == (1, "<|im_start|>\n<|im_end|>\n")


def test_branches_both_stay(spark):
    data = [(c, t, "user", x) for c, xs in {1: "ab", 2: "abc", 3: "abd"}.items() for t, x in enumerate(xs)]
    assert {r.conv_id for r in chat.render_chats(conv(spark, data)).collect()} == {2, 3}


def test_empty(spark):
    assert chat.render_chats(conv(spark, [])).count() == 0


def test_very_long_turns(spark):
    long = "word " * 200_000
    out = chat.render_chats(conv(spark, [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "ok")])).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(2, 2)] and long in out[0].rendered
