"""Perspective rotation against a plain version."""

import re
from collections import Counter

from evalmill.llm.chat_views import END, START, rotated

TURNS = "conv_id long, turn long, role string, text string, speaker string, name string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], TURNS)


ROWS = [
    (1, 0, "anna", "hi é😀"), (1, 1, "bert", "yo"), (1, 2, "cleo", ""), (1, 3, " anna ", None), (2, 0, "user", "q"), (2, 1, "assistant", "a"),
    (2, 1, "assistant", "a"), (2, None, "user", "when"), (3, 0, None, "who"), (3, 0, "  ", "me"), (None, 0, "user", "lost"), (4, 0, "solo", "x" * 100000),
]


def test_every_participant_is_the_assistant_once(spark):
    got = rotated(frame(spark, ROWS)).collect()
    rows = Counter((c, t, (r or "").strip() or "unknown", x or "") for c, t, r, x in ROWS if c is not None)
    speakers = {(c, by) for c, _, by, _ in rows}
    want = {}
    for (c, t, by, x), copies in rows.items():
        for d, view in speakers:
            if c == d:
                own = by == view
                header = START + ("assistant" if own else f"user name={by}") + "\n"
                rendered = header + x + END + "\n"
                want[(c, view, t, by, x)] = (copies, "assistant" if own else "user", None if own else by, rendered, len(header), len(header) + (len(x) + len(END) if own else 0))
    assert len(got) == len(want)
    for r in got:
        by = r.speaker if r.role == "assistant" else r.name
        x = r.rendered.split("\n", 1)[1][: -len(END) - 1]
        assert (r.copies, r.role, r.name, r.rendered, r.mask_start, r.mask_end) == want[(r.conv_id, r.speaker, r.turn, by, x)]
        assert r.rendered[r.mask_start : r.mask_end] == (x + END if r.role == "assistant" else "")


def test_a_view_is_the_dialogue_in_order(spark):
    rows = rotated(frame(spark, ROWS)).filter("conv_id = 1 AND speaker = 'bert'").orderBy("turn", "part").collect()
    assert "".join(r.rendered for r in rows) == (
        f"{START}user name=anna\nhi é😀{END}\n{START}assistant\nyo{END}\n{START}user name=cleo\n{END}\n{START}user name=anna\n{END}\n"
    )


def test_no_rows_and_native_plan(spark):
    assert rotated(frame(spark, [])).count() == 0
    plan = rotated(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
