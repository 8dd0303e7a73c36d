import os
from collections import Counter

import pytest

from docloom.operators import replies as R


def asked(folder):
    """Calls of each prompt, from the lines that clients wrote."""
    return Counter(line for f in os.listdir(folder) for line in open(f"{folder}/{f}").read().split("\n") if line)


def client_of(folder, dies_after=None):
    def client(prompt):
        if dies_after is not None and len(asked(folder)) >= dies_after:
            os._exit(1)  # the worker is gone, and with it the task
        with open(f"{folder}/{os.getpid()}", "a") as out:
            out.write(prompt + "\n")
        if prompt.startswith("bad"):
            raise ValueError(f"no {prompt}")
        return prompt.upper()

    return client


def test_a_killed_run_repeats_no_stored_call(spark, tmp_path):
    log, root = tmp_path / "log", f"file:{tmp_path}/replies"
    log.mkdir()
    rows = [(k, f"p{k % 70}") for k in range(100)] + [(200, None), (201, "bad 1"), (202, "bad 1")]
    df = spark.createDataFrame(rows, "doc_id int, prompt string").repartition(3)
    with pytest.raises(Exception):
        R.ask(df, client_of(str(log), 30), root, attempts=1, pause_s=0, calls=2, replies=1)
    kept = {r.raw for r in R.stored(spark, root).collect()}
    before = asked(log)
    assert 10 < len(kept) < 70
    got = {r.doc_id: (r.raw, r.error) for r in R.ask(df, client_of(str(log)), root, attempts=2, pause_s=0).collect()}
    assert got == {**{k: (p.upper(), None) for k, p in rows if p and not p.startswith("bad")}, 200: (None, None), 201: (None, "no bad 1"), 202: (None, "no bad 1")}
    now = asked(log)
    assert all(now[p.lower()] == before[p.lower()] == 1 for p in kept)  # stored calls weren't made again
    assert sum(now[f"p{k}"] for k in range(70)) <= 70 + 4 * 2  # what was under way when the workers went
    R.ask(df, client_of(str(log)), root, attempts=1, pause_s=0).collect()
    again = asked(log)
    assert {p for p in again if again[p] != now[p]} == {"bad 1"}


def test_no_prompts(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id int, prompt string")
    assert R.ask(df, str.upper, f"{tmp_path}/r").count() == 0
