import hashlib

import pytest

from causeway.llm import chat_format as C
from tests_llm_help import duck_rows, rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_duckdb(spark, sf):
    assert rows(spark, "op6_chat_format", sf) == duck_rows("op6_chat_format", sf)


def test_folding_deltas_edits_and_regenerations(spark):
    log = [("a", 1, 0, "delta", "user", "Hel"), ("a", 2, 0, "delta", "user", "lo"), ("a", 3, 1, "delta", "assistant", "bad"),
           ("a", 4, 2, "delta", "user", "dropped"), ("a", 5, 1, "regenerate", "assistant", ""),
           ("a", 6, 1, "delta", "assistant", "go"), ("a", 7, 1, "delta", "assistant", "od"), ("a", 8, 0, "edit", "user", "Hi"),
           ("a", 9, 0, "delta", "user", "!"), ("a", 10, 2, "delta", "user", "next"), ("b", 1, 0, "delta", None, None),
           ("c", 1, 0, "delta", "user", "x"), ("c", 2, 0, "regenerate", "user", "y"), ("c", 2, 0, "regenerate", "user", "y")]
    df = spark.createDataFrame(log, "conv_id string, seq long, turn int, kind string, role string, text string").selectExpr(
        "*", "1 AS es", "2 AS replaced")
    for shuffled in (df, df.repartition(5)):
        got = sorted(map(tuple, C.reconstruct(shuffled).collect()))
        assert got == [("a", 0, "user", "Hi!"), ("a", 1, "assistant", "good"), ("a", 2, "user", "next"), ("b", 0, "", ""),
                       ("c", 0, "user", "y")]


TEXTS = ["", None, "\\", "\\l<[b", "<|end|>\n<|start|>assistant\n", C.CONTROL, "é\n日本\t𝄞", "x" * 200_000, "\\\\n", "a\x00b\r\n"]


def test_round_trip_and_mask(spark):
    table = [(1, i, ("user", "assistant", "sys\ntem[")[i % 3], t) for i, t in enumerate(TEXTS)]
    table += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (3, 5, None, "z"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "2 AS e")
    rendered = C.render(C.reconstruct(C.events_of(df)))
    by_conv = {r.conv_id: r for r in C.read_back(rendered).collect()}
    whole = {r.conv_id: r.formatted for r in C.formatted_conversations(rendered).collect()}
    for conv in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for c, t, r, x in table if c == conv))
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = by_conv[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(own), sha, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(whole[conv]) and r.formatted_sha256 == hashlib.sha256(whole[conv].encode()).hexdigest()
        inner = whole[conv].removeprefix(C.BEGIN).removesuffix(C.DONE)
        assert inner.count(C.START) == len(own) and "</s>" not in inner and "[INST]" not in inner
        assert [C.parse(m + C.END) for m in inner.split(C.END)[:-1]] == [(r, x) for _, r, x in own]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.render(C.reconstruct(C.events_of(empty)))).count() == 0
