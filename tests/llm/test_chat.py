import hashlib
from pathlib import Path

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from seqloom.llm import chat, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{Path(SF) / 'conversations.parquet'}'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attached_tokens"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP13_SQL})").fetchall()
    got = [tuple(r) for r in queries.op13_chat_format(spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want) and got.count(min(got)) == 1 and min(got)[0] == -7


PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "[", "<", "s>", "|>", " ", "\n", "a", "INST]", "é😀"]), max_size=8).map("".join)
PARTS = st.one_of(PIECES.map(lambda t: {"type": "text", "text": t}), st.sampled_from(sorted(chat.PLACEHOLDERS)).map(lambda k: {"type": k, "ref": f"{k}.bin"}))


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), PIECES), st.lists(PARTS, max_size=4)), max_size=5))
def test_every_text_comes_back(turns):
    text, want, loss, attached = chat.BEGIN, [], "", []
    for role, parts in turns:
        turn, spans, found = chat.format_turn(role, parts, chat.Expansion())
        loss += "".join(chat.unescape(turn[a:b]) for a, b in spans)
        attached += [(len(text) + p, kind) for p, kind, _, _ in found]
        text += turn
        whole = []
        for p in parts:
            if p["type"] == "text" and whole and whole[-1][0] == "text":
                whole[-1] = ("text", whole[-1][1] + p["text"])
            else:
                whole.append((p["type"], p.get("text", "")))
        want.append((role, [p for p in whole if p[0] != "text" or p[1]]))
    assert list(chat.turns_of(text)) == want
    assert loss == "".join(t for role, parts in want if role == "assistant" for kind, t in parts if kind == "text")
    assert all(text[p:].startswith(chat.PLACEHOLDERS[kind]) for p, kind in attached)


def test_only_control_strings_are_escaped():
    assert chat.escape("a\\b [x] <p> \\frac") == "a\\b [x] <p> \\frac"
    assert chat.escape("\\</s>") == "\\\\</s>" and chat.unescape("\\\\</s>") == "\\</s>"


def _digests(rows):
    turns, loss = hashlib.sha256(), ""
    for role, text in rows:
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows_and_blocks(spark):
    long = "word [INST] " * 50_000
    convs = {
        1: [("user", "hi"), ("assistant", long), ("assistant", None), (None, "nobody"), ("tool [TEXT]", "{}")],
        2: [("assistant", ""), ("user", None)],
        None: [("user", "x"), ("user", "y")],
        3: [("user" if k % 2 else "assistant", f"turn {k} é") for k in range(2000)],
    }
    rows = [(c, k, role, text, "clash", 1) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA + ", block string, parts int").repartition(6)
    blocks = chat.format_conversations(df, block_chars=5000)
    found = blocks.collect()
    assert len([b for b in found if b.conv_id == 3]) > 5 and sum(b.n_turns for b in found) == len(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(blocks).collect()}
    assert got == {c: _digests(turns) for c, turns in convs.items()}
    whole = chat.format_conversations(df)
    assert {r.conv_id: r.formatted_chars for r in chat.read_back(whole).collect()} == {r.conv_id: r.formatted_chars for r in chat.read_back(blocks).collect()}
    assert chat.format_conversations(df.where("false")).collect() == []


def test_ties_repeats_and_null_turns(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "s"), (1, 1, "assistant", "z")]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got] == [_digests([("system", "s"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])]


def test_parts_become_placeholders_with_references(spark):
    schema = SCHEMA + ", parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", "not this", [part("text", "look "), part("text", "at [/INS"), part("text", "T]"), part("image", ref="a.png", w=28, h=29), part("audio", ref="b.wav", s=1.5), part("text", "\\")]),
        (1, 1, "assistant", None, [part("text", "see "), part("document", ref="c.pdf", p=3), None, part("video", ref="d"), part("odd", "as text"), part(None)]),
        (1, 2, "user", "its text", None), (1, 3, "user", "no", []),
    ]
    (block,) = chat.format_conversations(spark.createDataFrame(rows, schema), parts_col="parts").collect()
    assert [(a.kind, a.ref, a.n_tokens) for a in block.attachments] == [("image", "a.png", 6), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("file", "d", 1), ("file", None, 1)]
    assert block.attached_tokens == 6 + 38 + 768 + 2
    assert all(block.text[a.place :].startswith(chat.PLACEHOLDERS[a.kind]) for a in block.attachments)
    assert list(chat.turns_of(block.text)) == [
        ("user", [("text", "look at [/INST]"), ("image", ""), ("audio", ""), ("text", "\\")]),
        ("assistant", [("text", "see "), ("document", ""), ("file", ""), ("text", "as text"), ("file", "")]),
        ("user", [("text", "its text")]), ("user", []),
    ]
    assert "".join(block.text[s.start : s.stop] for s in block.loss) == "see as text"
    (read,) = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema), parts_col="parts")).collect()
    assert (read.n_attachments, read.attached_tokens, read.n_turns, read.loss_chars) == (5, 814, 4, 11)
