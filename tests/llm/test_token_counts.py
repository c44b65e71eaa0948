from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, token_counts

COUNTER = token_counts.PieceCounter(token_counts.MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "▁", "\n", "é", "日", "😀", "\t", "　", "</s>", "<s>", "<0x41>", "<unk>", "th", "ing", ".", "\x00"]), max_size=12).map("".join))
def test_count_equals_the_library(t):
    assert COUNTER.count(t) == len(COUNTER.library.encode(t))


def test_table_round_trip():
    table = {"a": 1, "b c": 2, "é": 3, "x": 300, "": 1}
    assert token_counts.unpack(token_counts.pack(table)) == {"a": 1, "é": 3, "": 1}
    assert token_counts.unpack(token_counts.pack({})) == {} == token_counts.unpack(b"")


def test_query(spark, sf_dir, texts):
    for r in queries.op4_token_counts(spark, sf_dir).collect():
        n = len(COUNTER.library.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)


def test_defined_results(nasty, nothing):
    rows = token_counts.count_tokens(nasty).collect()
    assert len(rows) == nasty.count()
    for r in rows:
        assert r["n_tokens"] == (len(COUNTER.library.encode(r["text"])) if r["text"] else 0)
    assert token_counts.count_tokens(nothing).count() == 0
