import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, duck
from decafix.llm import catalogue, chat

PART = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "[/", " ", "é", "\U0001f600", "a", "\n", "<\\s>", " [/INST] "])
TEXT = st.lists(PART, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_round_trip(turns):
    roles, texts = ([x[i].encode() for x in turns] for i in (0, 1))
    out, bounds, start, end = chat.assemble(roles, texts)
    data = out.tobytes()
    assert chat.parse(data) == list(zip(roles, texts, strict=True))
    assert [chat.unescape(data[a:b]) for a, b in zip(start, end, strict=True)] == texts and bounds[-1] == len(data)
    assert data.count(b"</s>") == data.count(b"<s>") == data.count(b"[INST]") == data.count(b"[/INST]") == len(turns)


def test_same_as_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(spark, duck(sf), catalogue.QUERIES["op2_chat"], catalogue.SQL["op2_chat"], sf) == ""


def test_edges(spark, monkeypatch):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 1, None, "x"), (None, 1, "user", "n"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 1, "assistant", "é</s>" * 100_000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i}\\") for i in range(3000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 6 and got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb\nassistant\n\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[2]["loss_chars"] == 0 and got[3]["loss_sha256"] == sha("samesame") and got[4]["loss_chars"] == 500_000
    assert got[5]["n_turns"] == 3000 and got[5]["loss_sha256"] == sha("".join(f"t{i}\\" for i in range(1, 3000, 2)))
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_conversation_over_many_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("decafix.llm.text.PIECE_BYTES", 8)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5 + [2]), pa.array(["user", "assistant"] * 3), pa.array([f"text {i}" for i in range(6)])], names=["c", "r", "t"])
    out = [r for b in chat._stream(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 5), (2, 1)]
    assert [r["formatted"][a:b] for r in out for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)] == [b"text 1", b"text 3", b"text 5"]
