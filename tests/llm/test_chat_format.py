import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thalweg.llm.chat_format import Budget, escape, format_conversations, format_turn, read_back, read_window, unescape, windows
from thalweg.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = r"\### Assistant: </turn> ok"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\/turn> \na%", max_size=30), st.text(max_size=6))
def test_escape_round_trip(text, role):
    assert unescape(escape(text)) == text
    assert "</turn" not in escape(text) and "<turn" not in escape(text)
    both = format_turn(role, text, False)[0] + format_turn("x", text, True)[0]
    assert [(r, t, a) for r, t, a, _, _ in read_window(both)] == [(role, text, False), ("x", text, True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 9)), max_size=25), st.integers(1, 20), st.integers(0, 12))
def test_windows(turns, size, history):
    given_turns = [(r, f"t{k}" * n, n) for k, (r, n) in enumerate(turns)]
    got = list(windows(iter(given_turns), Budget(size, history), "assistant"))
    new, masked = [], []
    for w in got:
        read = list(read_window(w["text"]))
        new += [(r, t) for r, t, again, _, _ in read if not again]
        masked += [w["text"][s["start"] : s["end"]] for s in w["loss"]]
        tokens = sum(len(t) and next(n for r2, t2, n in given_turns if t2 == t) for _, t, _, _, _ in read)
        assert tokens == w["n_tokens"]
        assert w["n_tokens"] <= size or w["new_turns"] == 1
        if given_turns[0][0] == "system":
            assert read[0][0] == "system" and read[0][1] == given_turns[0][1]
    assert new == [(r, t) for r, t, _ in given_turns]
    assert masked == [t for r, t, _ in given_turns if r == "assistant"]


def brute(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = 0
    for _, role, text in sorted(((t if t is not None else -1, r or "", x or "") for t, r, x in rows)):
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            n += len(text)
    return len(rows), turns.hexdigest(), n, loss.hexdigest()


def test_frames(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "system", "é" * 3000), (1, 3, "assistant", None), (2, None, None, ODD), (2, 0, "assistant", ""), (None, 1, "user", "x"), (None, 1, "user", "x")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 90)) for k in range(700)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_tokens string")
    made = format_conversations(df, PATH, Budget(200, 60))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(made).collect()}
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r, x))
    assert got == {c: brute(v) for c, v in want.items()}
    assert read_back(format_conversations(df.limit(0), PATH)).count() == 0


def test_encoder_matches_library(spark):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    e = Encoder(PATH, 50)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for x in [*texts, "", " ", "a  b", "a\n\nb", "a \nb", " a", "a ", "\na", "a  b", "日本 語　x", "<|endoftext|> x", "it's we'll\x1cx 12 3", "a\r\nb c"]:
        assert e.encode(x) == e._ids(x), x


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '1s.\n\t\r é日\x1c", max_size=25))
def test_encoder_on_odd_texts(text):
    e = Encoder.kept = getattr(Encoder, "kept", None) or Encoder(PATH, 50)
    assert e.encode(text) == e._ids(text)


def test_null_ids_beside_large_ones(spark):
    rows = [(2**53 + k, 0, "user", f"text {k}") for k in range(4)] + [(None, 0, "user", "none"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    for ordered in (False, True):
        got = {r.conv_id: r.n_turns for r in read_back(format_conversations(df, PATH), ordered).collect()}
        assert got == {2**53 + k: 1 for k in range(4)} | {None: 2}


def test_a_very_long_text(spark):
    text = "one <turn two </turn> three " * 60_000
    df = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "assistant", text), ("c", 2, "assistant", "end")], "conv_id string, turn long, role string, text string")
    got = read_back(format_conversations(df, PATH)).collect()
    want = hashlib.sha256(f"user\nhi\nassistant\n{text}\nassistant\nend\n".encode()).hexdigest()
    assert [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars) for r in got] == [("c", 3, want, len(text) + 3)]
