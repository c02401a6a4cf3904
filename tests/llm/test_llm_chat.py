import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cohortflow.llm import chat

BITS = st.lists(st.sampled_from(["\\", "#", "##", "### ", "</turn>", "</turn", "<", "\n", ":\n", " x", "é", "assistant"]), max_size=8).map("".join)


@given(st.lists(st.tuples(BITS, BITS), max_size=5))
def test_round_trip(turns):
    out = chat.turn_template(turns)
    assert chat.read_back(out) == turns
    done = chat.render(chat.turn_template, turns)
    assert done.rewritten_at is None
    assert [out[a:b] for a, b in done.spans] == [chat.turn_template([t]) for t in turns]


def others():
    """Templates made in a function, which ships them to tasks by value."""
    def with_start(turns):
        return "<s>" + chat.turn_template(turns)

    def last_marked(turns):
        return "".join(f"[{r}]{x}" + "!" * (k == len(turns) - 1) for k, (r, x) in enumerate(turns))

    def thoughts_dropped(turns):  # but for the last answer's
        last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}]" + (x if k == last else x.rpartition("</think>")[2]) for k, (r, x) in enumerate(turns))

    return with_start, last_marked, thoughts_dropped


def test_probe():
    with_start, last_marked, thoughts_dropped = others()
    assert chat.probe(chat.turn_template) == "blocks"
    assert chat.probe(with_start) == "appends"
    assert chat.probe(last_marked) == "rewrites"
    assert chat.probe(thoughts_dropped) == "rewrites"
    done = chat.render(last_marked, [("user", "a"), ("assistant", "b")])
    assert done.rewritten_at == 1 and done.spans[1][1] == len(done.text)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, part string")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (
            -1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), len(chat.turn_template(turns)))
    return out


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi", "x", "y"), (1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", None, "x", "y"), (1, None, None, "a", "x", "y"),
            (None, 0, "user", "lost", "x", "y"), (2, 0, "assistant", "long " * 30_000, "x", "y"), (3, 5, "a\nb", "\\### </turn>", "x", "y"),
            *[(4, k, ("user", "assistant")[k % 2], f"t{k} ##", "x", "y") for k in range(150)], *[(5, 0, "user", f"{k:03}", "x", "y") for k in range(60)]]
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.format_conversations(table(spark, rows))).collect()}
    assert got == brute(rows)
    assert chat.digests(chat.format_conversations(table(spark, rows[:0]))).collect() == []


def test_whole_conversations_for_other_templates(spark):
    with_start, last_marked, _ = others()
    rows = [(1, k, "user", f"t{k}", "x", "y") for k in range(40)]
    got = chat.format_conversations(table(spark, rows), with_start).collect()
    assert len(got) == 1 and got[0]["formatted"] == with_start([("user", f"t{k}") for k in range(40)])
    flagged = chat.format_conversations(table(spark, rows), last_marked).collect()
    assert flagged[0]["rewritten_at"] == 1


def long_range():
    """Templates that change history only where a short trial doesn't look."""
    def window(turns):
        return "".join(f"[{r}]{x}" for r, x in turns[-8:])

    def numbered(turns):
        return "".join(f"[{r}]{x}" + "!" * (k > 20) for k, (r, x) in enumerate(turns))

    def tools_merged(turns):
        out, before = "", None
        for r, x in turns:
            out = out[:-1] + f"+{x}]" if r == before == "tool" else out + f"[{r}:{x}]"
            before = r
        return out

    return window, numbered, tools_merged


@pytest.mark.parametrize("k, first", [(0, 8), (1, None), (2, 20)])
def test_templates_that_a_trial_takes_for_blocks(spark, k, first):
    template = long_range()[k]
    assert chat.probe(template) == "blocks"
    turns = [("tool" if k in (19, 20) else "user", f"t{k}") for k in range(40)]
    rows = [(1, k, r, x, "x", "y") for k, (r, x) in enumerate(turns)]
    got = chat.format_conversations(table(spark, rows), template).orderBy("block", "part").collect()
    assert "".join(r["formatted"] for r in got) == template(turns)
    assert [r["rewritten_at"] for r in got] == [first]


def test_blocks_are_declared(spark):
    rows = [(1, k, "user", f"t{k}", "x", "y") for k in range(40)]
    got = chat.format_conversations(table(spark, rows), joins=True).orderBy("block", "part").collect()
    assert [r["n_turns"] for r in got] == [16, 16, 8]
    assert "".join(r["formatted"] for r in got) == chat.turn_template([("user", f"t{k}") for k in range(40)])
    with pytest.raises(ValueError, match="join"):
        chat.format_conversations(table(spark, rows), others()[1], joins=True)
