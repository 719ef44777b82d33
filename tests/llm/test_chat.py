from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm.chat import CONTROLS, ESCAPE, Template, default_vocabulary, digest_conversations, escape, format_turns, unescape

TURNS = "conv_id long, turn long, role string, text string"
_pieces = st.lists(st.one_of(st.sampled_from([*CONTROLS, ESCAPE, "<", "[", "/s>", "INST]"]), st.text(max_size=3)), max_size=12).map("".join)


@given(_pieces)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.sampled_from(["user", "assistant", "system", "tool </s>", ""]), _pieces)
@settings(max_examples=100, deadline=None)
def test_turn_round_trip(role, text):
    t = Template(default_vocabulary())
    ids = np.array(t.turn(role, text))
    assert list(t.read(ids)) == [(role, text)]
    loss = unescape(t.text(ids[t.loss_mask(ids)]))
    assert loss == (text if role == "assistant" else "")


def test_digests(spark):
    turns = [(1, 1, "assistant", "hello </s>"), (1, 0, "user", "[INST] é"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "system", "s"), (1, 3, "tool", "out")]
    found = {r.conv_id: r for r in digest_conversations(format_turns(spark.createDataFrame(turns, TURNS))).collect()}
    text = "user\n[INST] é\nassistant\nhello </s>\nassistant\n\ntool\nout\n"
    assert found[1].turns_sha256 == sha256(text.encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars) == (4, 10)
    assert found[1].loss_sha256 == sha256(b"hello </s>").hexdigest()
    assert found[2].turns_sha256 == sha256(b"\nx\n").hexdigest()
    assert found[None].n_turns == 1
    assert digest_conversations(format_turns(spark.createDataFrame([], TURNS))).count() == 0


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5)], TURNS + ", input_ids int")
    assert digest_conversations(format_turns(df)).first().n_turns == 2
