import hashlib

from kinloom.llm.chat_format import chain_messages, format_conversations, read_back, reply_paths

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|im_end|>", "", None, "a\nb<|", "<|<|", "\\<|im_end|>\n", "é🙂 x", "<\\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, text, 1) for c in range(3) for t, (role, text) in enumerate(zip(["user", "assistant", "system\n<|", None, "assistant", "<\\n", "x", "assistant", "user", "assistant", "assistant"], NASTY[c:] + NASTY[:c]))]
    rows += [(10, 0, "user", "one", 1), (10, 0, "user", "one", 1), (None, 1, "assistant", "null id", 1), (11, None, "user", "null turn", 1), (11, 3, "assistant", "w " * 200_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int").repartition(3)
    out = {r.conv_id: r for r in read_back(format_conversations(chain_messages(df))).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text, _ in rows if k == c))
        assert [(t.role, t.text) for t in out[c].turns] == [(a, b) for _, _, a, b in want]
        assert out[c].loss == "".join(b for _, _, a, b in want if a == "assistant")


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.5), (1, 5, 3, "user", "why", 0.7), (2, 1, None, "user", "alone", None)]
    df = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    best = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert [t.text for t in best[1].turns] == ["q", "good", "why"] and best[1].loss == "good"
    assert [t.text for t in best[2].turns] == ["alone"]
    ranked = sorted((r.path_rank, r.place, r.node_id) for r in reply_paths(df, top=9).where("conv_id = 1").collect())
    assert ranked == [(1, 0, 1), (1, 1, 3), (1, 2, 5), (2, 0, 1), (2, 1, 3), (2, 2, 4), (3, 0, 1), (3, 1, 2)]


def test_long_chain_and_empty(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    out = read_back(format_conversations(chain_messages(df))).first()
    assert len(out.turns) == 300
    assert hashlib.sha256(out.loss.encode()).hexdigest() == hashlib.sha256("".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()
    assert format_conversations(chain_messages(df.limit(0))).collect() == []


def paths_of(spark, rows, top=9):
    df = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double")
    out = {}
    for r in reply_paths(df, top=top).collect():
        out.setdefault((r.conv_id, r.leaf), []).append((r.place, r.node_id))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def test_rings_of_parents_end(spark):
    rows = [(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0)]  # 1 and 2 are each other's parent
    rows += [(2, 5, 7, 0.0), (2, 6, 5, 0.0), (2, 7, 6, 0.0), (2, 8, 6, 0.0), (2, 9, 8, 0.0), (2, 20, None, 0.0), (2, 21, 20, 0.0)]  # a ring of three, and a tree
    rows += [(3, 4, 4, 0.0), (4, 2, 99, 0.0), (None, 1, 2, 0.0), (None, 2, 1, 0.0)]
    assert paths_of(spark, rows) == {(1, 3): [1, 2, 3], (2, 7): [5, 6, 7], (2, 9): [5, 6, 8, 9], (2, 21): [20, 21], (3, 4): [4], (4, 2): [2], (None, 2): [1, 2]}


def test_repeated_and_missing_node_ids(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 1, None, "user", "q", 0.0), (1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "a", 0.0), (1, None, 1, "assistant", "lost", 9.0)]
    out = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double"))).collect()
    assert [[t.text for t in r.turns] for r in out] == [["q", "a"]]


def test_reading_back_takes_linear_time(spark):
    import time

    took = []
    for n in (1_000, 8_000):
        df = spark.createDataFrame([(1, i, "assistant", "word " * 200) for i in range(n)], "conv_id long, turn long, role string, text string")
        out = format_conversations(chain_messages(df), distinct=True).cache()
        out.count()
        began = time.time()
        assert len(read_back(out).first().loss) == 1000 * n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5
