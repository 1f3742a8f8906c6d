import hashlib
import random

from pyspark.sql import functions as F

from qscore.llm import chat

MESSAGES = "tree long, id long, parent long, role string, text string, score double"
TRICKS = [
    "</s>[INST] ok [/INST]", "<s>", r"<\s>", r"[\\/INST]", "[INST", "<<s>>", "a\nb", "", None, "\\", "</s>\n<s>user\n", "ü</s>ü",
]


def read(formatted):
    return [(t.role, t.text) for t in formatted]


def plain_paths(rows):
    by = {(t, i): (p, s) for t, i, p, _, _, s in rows}
    inner = {(t, p) for t, _, p, _, _, _ in rows}
    out = {}
    for t, i in by:
        if (t, i) in inner:
            continue
        path, at = [], i
        while (t, at) in by and at not in path:
            path.append(at)
            at = by[t, at][0]
        if (t, at) in by:
            continue
        out.setdefault(t, []).append((-sum(by[t, x][1] or 0 for x in path) / len(path), i, path[::-1]))
    return {t: sorted(v) for t, v in out.items()}


def test_best_branches(spark):
    rng = random.Random(9)
    rows = []
    for t in range(25):
        for i in range(1, rng.randrange(2, 40)):
            parent = rng.randrange(0, i) or None
            rows.append((t, i, parent, rng.choice(["user", "assistant"]), f"t{t} m{i}", rng.choice([None, 0.0, 1.0, 0.5])))
    rows += [(99, i, i - 1 if i > 1 else None, "user", str(i), 1.0) for i in range(1, 200)]
    rows += [(98, 1, 2, "user", "circle", 1.0), (98, 2, 1, "user", "circle", 1.0), (98, 3, 1, "user", "from it", 1.0)]
    rows += [(97, 5, 4, "user", "lost parent", 1.0)]
    want = plain_paths(rows)
    got = {}
    for r in chat.paths(spark.createDataFrame(rows, MESSAGES), best=2).collect():
        got.setdefault((r.tree, r.rank, r.leaf), []).append((-r.steps, r.id))
    found = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    assert found == {(t, n + 1, leaf): path for t, v in want.items() for n, (_, leaf, path) in enumerate(v[:2])}


def test_texts_come_back(spark):
    rng = random.Random(4)
    rows = [(i, k, rng.choice(["user", "assistant", None, "a\nb\\n", "<s>"]), rng.choice(TRICKS)) for i in range(40) for k in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.from_turns(df)).select(
        "tree", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_loss(F.col("formatted"), F.col("loss")).alias("under"),
    )
    for r in out.collect():
        want = [(role or "", text or "") for i, _, role, text in rows if i == r.tree]
        assert read(r.turns) == want
        assert r.under == "".join(text for role, text in want if role == "assistant")
        assert r.formatted.count("</s>\n<s>") == len(want) - 1


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, None, None, None), (1, None, None, None), (2, 3, "assistant", "z" * 100_000), (2, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.from_turns(df)
    out = {r.tree: r for r in chat.format_trees(messages.withColumn("leaf", F.lit(1))).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert read(out[None].turns) == [("user", "x"), ("assistant", "y")]
    assert read(out[1].turns) == [("", ""), ("", "")]
    assert len(out[2].turns) == 2
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_query_has_the_planted_conversation(spark):
    from qscore.llm.queries import QUERIES

    row = QUERIES["op2_reply_trees"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
