import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tessera.llm import chat as C

NASTY = [C.PROBE, C.START, C.STOP + "\n", "<|", "<\\|im_end|>", "<\\\\|", "a\nb", "", None, "\n", "<<|im_end|", "<|im_end|>\n<|im_start|>user\nx", "é漢🙂", "%0A"]


def test_round_trip_of_nasty_turns(spark):
    rows = [(i, 0, r, t, "x") for i, (r, t) in enumerate((r, t) for r in ["user", "assistant", None, "a\nb", "%250A|", C.START, C.STOP] for t in NASTY)]
    rows += [(1000, n, "assistant", t, "x") for n, t in enumerate(NASTY)] + [(None, None, "user", "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")
    got = C.format_chats(df).collect()
    assert len(got) == 7 * len(NASTY) + 2 and all(r.round_trip for r in got)
    by = {r.id: [(t.role, t.text) for t in r.turns] for r in got}
    assert by[1000] == [("assistant", t or "") for t in NASTY]
    plain = next(r for r in got if r.id == NASTY.index("a\nb"))
    assert plain.formatted == "<|im_start|>user\na\nb<|im_end|>\n"  # no conflict, no escape


def test_broken_text_is_refused(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n"]
    df = spark.createDataFrame([(t,) for t in bad], "t string").select(C.parse(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == [None] * 4


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(i // 4, i % 4, ["system", "user", "assistant", None][i % 4], NASTY[i % len(NASTY)]) for i in range(80)] + [(3, 1, "user", "twice")] * 2
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    frame.to_parquet(tmp_path / "conversations.parquet")
    got = sorted(tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in C.op3_chat(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert got == sorted(con.execute(C.ORACLE_SQL).fetchall())


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
