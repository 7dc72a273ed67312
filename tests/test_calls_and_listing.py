import os

import pytest
from pyspark.sql import functions as F

from tabletrail.operators import replies
from tabletrail.operators.replies import call_model, stored_replies
from tabletrail.sources import scripts


def prompts(spark, n=40):
    return spark.createDataFrame([(f"c{i}", f"prompt {i % (n // 2)}") for i in range(n)], "chunk_id string, prompt string")


def test_a_run_after_a_lost_worker_asks_for_what_is_missing(spark, tmp_path):
    calls, store, switch = tmp_path / "calls", str(tmp_path / "store"), tmp_path / "healthy"
    calls.mkdir()

    def answer(prompt):
        if prompt == "prompt 13" and not switch.exists():
            os._exit(1)  # the worker dies with calls behind it
        if prompt == "prompt 5":
            raise ValueError("no answer")
        with open(calls / prompt, "a") as file:
            file.write("x")
        return prompt.upper()

    inputs = prompts(spark)
    with pytest.raises(Exception, match="(?i)worker|task|abort"):
        call_model(inputs, answer, 1, store).collect()
    before = {p.name for p in calls.iterdir()}
    assert stored_replies(spark, store).count() == len(before) < 19
    switch.write_text("")
    rows = {r["chunk_id"]: (r["reply"], r["error"]) for r in call_model(inputs, answer, 3, store, at_once=4).collect()}
    assert len(rows) == 40 and rows["c5"] == rows["c25"] == (None, "ValueError: no answer")
    assert all(rows[f"c{i}"] == (f"PROMPT {i % 20}", None) for i in range(40) if i % 20 != 5)
    assert {p.name: p.read_text() for p in calls.iterdir()} == {f"prompt {i}": "x" for i in range(20) if i != 5}, "each prompt once"

    def never(prompt):
        raise KeyError(prompt)

    again = call_model(inputs, never, 2, store)
    assert {r["chunk_id"] for r in again.where("error IS NOT NULL").collect()} == {"c5", "c25"}
    with pytest.raises(ValueError, match="workers can open"):
        call_model(inputs, never, 2, "s3://bucket/replies")


def test_a_line_cut_off_is_asked_again(spark, tmp_path):
    run = tmp_path / "store" / "run-1"
    run.mkdir(parents=True)
    inputs = spark.createDataFrame([("a", "one"), ("b", "two")], "chunk_id string, prompt string")
    keys = {r["prompt"]: r["k"] for r in inputs.select("prompt", F.sha2("prompt", 256).alias("k")).collect()}
    (run / "p000000-1.jsonl").write_text(f'{{"key": "{keys["one"]}", "reply": "kept"}}\n{{"key": "{keys["two"]}", "rep')
    rows = {r["chunk_id"]: r["reply"] for r in call_model(inputs, str.upper, 1, str(tmp_path / "store")).collect()}
    assert rows == {"a": "kept", "b": "TWO"}


def test_listing_in_tasks_equals_the_ordinary_scan(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(30):
        folder = root / f"a{i % 4}" / f"b{i % 3}" / ("c" * (i % 5 + 1))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"job{i}{['.sql', '.py', '.sh', '.txt'][i % 4]}").write_bytes(f"line {i}\r\nnext é\n".encode() + (b"\xff" if i == 3 else b""))
    (root / "empty.sql").write_text("")
    plain = {tuple(r) for r in scripts.read_scripts(spark, str(root), ["b1"]).collect()}
    listed = {tuple(r) for r in scripts.read_scripts(spark, str(root), ["b1"], include_hidden=True).collect()}
    assert listed - plain == {(str(root / "empty.sql"), "")} and plain < listed and len(plain) > 10
    (root / ".hidden").mkdir()
    (root / ".hidden" / "_more.sql").write_text("SELECT 1")
    (root / "loop").symlink_to(root)
    more = {tuple(r) for r in scripts.read_scripts(spark, str(root), ["b1"], include_hidden=True).collect()}
    assert more - listed == {(str(root / ".hidden" / "_more.sql"), "SELECT 1")}
    small = scripts._read_listed(spark, str(root), part_bytes=20)
    assert small.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and small.count() == scripts._read_listed(spark, str(root)).count()
    assert scripts.read_scripts(spark, str(tmp_path / "nowhere"), include_hidden=True).count() == 0


def test_fallback_asks_each_prompt_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def answer(prompt: str) -> str:
        with open(log, "a") as file:
            file.write(prompt + "\n")
        if prompt == "bad":
            raise RuntimeError("no answer")
        return '[{"raw": "x", "canonical": "y", "type": "READ"}]'

    inputs = spark.createDataFrame([("1", "good"), ("2", "bad")], "chunk_id string, prompt string")
    ref = "array<struct<ord:int,raw:string,canonical:string,ref_type:string,confidence:string>>"
    found = spark.createDataFrame([("1", [(0, "a", "a", "READ", "low")]), ("2", [(0, "b", "b", "WRITE", "medium")])], f"chunk_id string, refs {ref}")
    rows = replies.refs_with_fallback(replies.call_model(inputs, answer), found).collect()
    assert sorted((r["chunk_id"], r["raw"], r["ref_type"]) for r in rows) == [("1", "x", "READ"), ("2", "b", "WRITE")]
    with open(log) as file:
        assert sorted(file.read().split()) == ["bad", "good"]
