import hashlib

from gyre.llm.chat import CONTROL, PATTERN, VOCABULARY, _digests, DIGEST, assemble, escape, formatted_turns, read_back, unescape
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.lists(st.one_of(st.sampled_from([*CONTROL, "\\", "\\\\", "<", "[", "|>", "é", "\n"]), st.text(st.characters(codec="utf-8"), max_size=6)), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from(["user", "assistant", "system", "", "tool|>"]))
def test_round_trip(text, role):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)
    ids, mask = assemble(role, text, VOCABULARY, PATTERN)
    back = read_back(ids, mask, VOCABULARY, PATTERN)
    assert back[:3] == (role, text, text if role == "assistant" else "")
    assert sum(back[3].count(c) for c in CONTROL) == (2 if role in ("user", "assistant", "system") else 3)


def test_digests_of_conversations(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a<|end|>b"), (1, 2, "assistant", None), (2, 0, None, ""), (None, None, "tool", "x"), (1, 10, "assistant", "ü" * 5000), (2, 0, "user", "t")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    found = {r.conv_id: r for r in formatted_turns(table).mapInArrow(_digests(VOCABULARY, PATTERN), DIGEST).collect()}
    for conv in (1, 2, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] or 0, r[2] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert formatted_turns(table.limit(0)).collect() == []
