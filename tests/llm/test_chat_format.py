from llm_helpers import rows
from pyspark.sql import functions as F

from demandkit.llm import chat_format as chat


def shown(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def spans(turns):
        out, at = [], 0
        for r, t in turns:
            start = at + len(f"<|{r}|>\n")
            at = start + len(t) + len("<|end|>\n")
            if r == "assistant":
                out.append((start, at))
        return out

    c, r = chosen[n:], rejected[n:]
    return n, shown(chosen[:n]), shown(c), shown(r), spans(c), spans(r)


U, A, S = "user", "assistant", "system"
PAIRS = [
    ([(S, "be kind"), (U, "hi"), (A, "hello")], [(S, "be kind"), (U, "hi"), (A, "no")]),
    ([(U, "hi"), (A, "same")], [(U, "hi"), (A, "same")]),
    ([(U, "a"), (A, "b")], [(U, "x"), (A, "y"), (U, "z"), (A, "ü日")]),
    ([(U, "a")], [(U, "a"), (A, "b"), (U, "c"), (A, "d")]),
    ([], [(U, "a")]),
    (None, None),
    (None, [(A, "")]),
    ([(A, "x" * 100_000)], [(A, "x" * 99_999)]),
]


def test_pairs_against_brute_force(spark):
    schema = f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string, start int"
    data = [(i, c, r, "old", 1) for i, (c, r) in enumerate(PAIRS)] * 2
    got = chat.format_pairs(spark.createDataFrame(data, schema))
    assert got.columns == ["pair_id", "start", *chat.OUTPUT]
    assert got.count() == 2 * len(PAIRS)
    for r in got.collect():
        own = (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans])
        assert own == brute(*PAIRS[r.pair_id])
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.end].endswith("<|end|>\n") for s in spans)


def test_pairs_from_conversations(spark):
    turns = [
        (1, 0, U, "q"), (1, 1, A, "good"), (1, 2, U, "thanks"),
        (2, 0, U, "other"), (2, 1, A, "bad"),
        (3, 0, U, "alone"),
        (5, 1, A, "late"), (5, 0, U, "first"), (5, None, None, None),
        (6, 0, U, "q"), (6, 1, A, "same"), (7, 0, A, "same"),
        (None, 0, A, "lost"),
    ]
    got = chat.neighbour_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    pairs = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in got.collect()}
    assert pairs == {
        1: ([(U, "q"), (A, "good")], [(U, "q"), (A, "bad")]),
        2: ([(U, "other"), (A, "bad")], [(U, "other")]),
        5: ([("", ""), (U, "first"), (A, "late")], [("", ""), (U, "first"), (A, "same")]),
        6: ([(U, "q"), (A, "same")], [(U, "q"), (A, "same")]),
        7: ([(A, "same")], []),
    }


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_pairs(chat.neighbour_pairs(none)).count() == 0
    one = spark.createDataFrame([(1, 0, A, "x")], "conv_id long, turn long, role string, text string")
    clash = one.select("*", F.lit("z").alias("turns"), F.lit("z").alias("chosen"))
    assert rows(chat.format_pairs(chat.neighbour_pairs(clash)), "conv_id", "chosen") == [(1, "<|assistant|>\nx<|end|>\n")]


def test_rows_without_a_conversation_give_none(spark):
    """Rows without conv_id are not one conversation; ids at both ends of the range; repeated and NULL turns."""
    low, high = -(2**63), 2**63 - 1
    data = [(None, 1, U, "one"), (None, 2, A, "dialogue"), (None, 1, U, "another"), (None, 2, A, "reply")]
    data += [(low, 1, U, "q"), (low, 2, A, "r"), (low + 1, 1, A, "s"), (high, 1, U, "q"), (high, 1, U, "q"), (high, 2, A, "t"), (high, None, S, None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_pairs(chat.neighbour_pairs(frame)).collect()}
    assert set(got) == {low, low + 1, high}
    assert got[low].rejected == shown([(A, "s")]) and got[high].rejected == ""
    assert got[high].prompt == shown([(S, ""), (U, "q"), (U, "q")])
