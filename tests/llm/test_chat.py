from sparloom.llm import chat
from sparloom.llm.encode import TOKENIZER_DIR, VOCABULARY, encoder


def test_encoding_and_reasons(spark):
    turns = lambda *x: list(zip(("system", "user", "assistant"), x))
    rows = [(1, turns("s", "Sort a list.", "sorted(x)")), (2, turns("s", "u", " ")), (3, None), (4, turns("s", None, "a")), (5, turns("s", "u", "long " * 200)), (6, turns("s", "u", "a")[:2])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role: string, content: string>>")
    got = {r["id"]: r for r in chat.encoded(df, "messages", 100).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {1: None, 2: "empty_assistant_content", 3: "invalid_messages", 4: "non_string_message_content", 5: "exceeds_max_length", 6: "invalid_messages"}
    own = encoder(f"{TOKENIZER_DIR}/{VOCABULARY}")
    ids = own.encode("<|system|>\ns\n<|user|>\nSort a list.\n<|assistant|>\nsorted(x)\n<|end|>")
    assert list(got[1]["input_ids"]) == ids and got[3]["input_ids"] is None
    labels = list(got[1]["labels"])
    shared = labels.count(-100)
    assert 0 < shared < len(ids) and labels[shared:] == ids[shared:]
    assert chat.encoded(df.limit(0), "messages", 100).count() == 0
