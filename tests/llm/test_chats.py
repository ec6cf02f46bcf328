"""Chat formatting: what is read back equals what was said, spans and places are right."""
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lanewise.llm import chat_parts as chat

SAID = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "\\", "<", "a<|end|>\n<|turn|>assistant\nb", "\\<|turn|>", "tail\\", "<|", "|>\n", "\\n", "\\\\<|image|>", "Zürich 😀\n\n", "x" * 3]
TEXTS = st.lists(st.sampled_from([*"\\<|>n\na😀", "<|end|>\n", "<|turn|>", "<|image|>"]), max_size=8).map("".join)
PARTS = st.lists(st.one_of(TEXTS.map(lambda t: {"type": "text", "text": t}), st.sampled_from(["image", "audio", "document"]).map(lambda k: {"type": k})), max_size=5)


@settings(max_examples=300, deadline=None)
@given(TEXTS, PARTS)
def test_messages_are_read_back(role, parts):
    piece = "".join(chat.message(role, parts, frozenset(), chat.Expansion()).out)
    want = []  # neighbouring texts are one, empty ones none
    for p in parts:
        if p["type"] != "text":
            want.append((p["type"], ""))
        elif p["text"]:
            want[-1:] = [("text", want[-1][1] + p["text"])] if want and want[-1][0] == "text" else [*want[-1:], ("text", p["text"])]
    assert chat.read_back(piece) == (role, want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TEXTS, PARTS), max_size=4))
def test_a_conversation_falls_apart_at_its_turns_only(messages):
    pieces = ["".join(chat.message(r, p, frozenset(), chat.Expansion()).out) for r, p in messages]
    whole, starts = "".join(pieces), [m.start() for m in chat.MARK.finditer("".join(pieces)) if m[1] == "turn" and not chat._is_escape("".join(pieces), m.start())]
    assert [whole[a:b] for a, b in zip(starts, [*starts[1:], None])] == pieces


def test_attachments_have_places_and_tokens():
    parts = [{"type": "text", "text": "see <"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.01},
             None, {"type": "document", "ref": None, "pages": 3}, {"type": "video", "ref": "v"}, {"type": "image", "width": -5, "height": None}]
    v = chat.message("assistant", parts, frozenset(["assistant"]), chat.Expansion(28, 12.5, 512))
    piece = "".join(v.out)
    assert [(a["part"], a["type"], a["ref"], a["tokens"]) for a in v.attachments] == [
        (1, "image", "a.png", 3), (2, "audio", "b.wav", 13), (4, "document", None, 1536), (5, "video", "v", 1), (6, "image", None, 1)]
    assert [piece[a["start"]:].split("|>")[0] for a in v.attachments] == ["<|image", "<|audio", "<|document", "<|other", "<|image"]
    assert [chat.unescaped(piece[a:a + n]) for a, n in v.spans] == ["see <"]
    assert chat.message(None, None, frozenset(), chat.Expansion()).at == len("<|turn|>\n<|end|>\n")


def plain(rows):
    """The digests of plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for *_, r, t in mine)
        loss = "".join(t or "" for *_, r, t in mine if r == "assistant")
        marked = sum(17 + len(r or "") + sum((r or "").count(c) for c in "\\<\n") + len(t or "") + sum((t or "").count(c) for c in "\\<") for *_, r, t in mine)
        out[conv] = (len(mine), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), marked)
    return out


@pytest.mark.parametrize("ranges", [1, 8])
def test_digests_of_conversations(spark, ranges):
    rows = [(c, t, ("user", "assistant", "system\n<", None)[t % 4], NASTY[(c * 5 + t) % len(NASTY)]) for c in range(20) for t in range(c % 7 + 1)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t} <\\" if t % 9 else None) for t in range(600)]  # most of all rows
    rows += [(None, t, "assistant", "no id") for t in range(3)] + [(7000, None, "user", "first"), (7000, 1, "assistant", "y"), (7000, 1, "assistant", "y")]
    rows += [(8000, 0, "assistant", "<long\\ " * 300_000)]
    table = spark.createDataFrame(rows, SAID).withColumns({"piece": F.lit("clash"), "start": F.lit(1)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == 1).lower())
    try:
        pieces = chat.format_messages(table.withColumn("parts", chat.text_parts(F.col("text"))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = chat.digests(pieces).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == plain(rows)
    long = pieces.where("conv_id = 500").orderBy("place").collect()  # places and starts go on over the ranges
    assert [r.place for r in long] == list(range(600)) and [r.turn for r in long] == list(range(600))
    assert [r.start for r in long] == [sum(len(x.piece) for x in long[:i]) for i in range(600)]
    assert chat.digests(chat.format_messages(table.withColumn("parts", chat.text_parts(F.col("text"))).limit(0))).count() == 0


def test_typed_parts_of_a_table(spark):
    rows = spark.sql("""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, from_json('[{"type":"image","ref":"a","width":56,"height":28},
        {"type":"text","text":"what?"}]', 'array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>') AS parts""")
    row = chat.format_messages(rows).first()
    assert row.piece == "<|turn|>user\n<|image|>what?<|end|>\n" and row.expanded_tokens == 2 and row.loss == []
    assert row.attachments[0].asDict() == {"part": 0, "type": "image", "ref": "a", "start": 13, "tokens": 2}
    no_parts = rows.withColumn("parts", F.lit(None).cast(rows.schema["parts"].dataType))
    assert chat.format_messages(no_parts).first().piece == "<|turn|>user\n<|end|>\n"
