"""Resumable memo batches: no finished call is repeated, calls are bounded and backed off."""

import os
import time
from collections import Counter

import pytest

from alphaloom.operators import memo_jobs as mj


class CountingModel:
    """Leaves a file for the start and one for the end of every call; may kill its worker or fail at first."""

    def __init__(self, folder, kill_on=None, fail_times=0, seconds=0.0):
        self.folder, self.kill_on, self.fail_times, self.seconds = str(folder), kill_on, fail_times, seconds

    def _note(self, kind, prompt):
        with open(f"{self.folder}/{kind}-{prompt}-{time.time_ns()}-{os.getpid()}", "w"):
            pass

    def __call__(self, prompt):
        if prompt == self.kill_on:
            time.sleep(3)               # the other lanes finish and commit
            os._exit(1)
        self._note("start", prompt)
        time.sleep(self.seconds)
        tried = sum(n.startswith(f"start-{prompt}-") for n in os.listdir(self.folder))
        if tried <= self.fail_times:
            raise RuntimeError("busy")
        self._note("end", prompt)
        return f"memo of {prompt}"


def noted(folder, kind):
    return Counter(n.split("-")[1] for n in os.listdir(folder) if n.startswith(kind))


def jobs(spark, n):
    return spark.createDataFrame([(f"T{i}", f"p{i}") for i in range(n)], "ticker string, prompt string")


def options(**more):
    return {"max_in_flight": 4, "attempts": 1, "sleep": None} | more


def test_a_killed_run_repeats_no_finished_call(spark, tmp_path):
    folder, path = tmp_path / "calls", str(tmp_path / "results")
    folder.mkdir()
    with pytest.raises(Exception):
        mj.run_calls(jobs(spark, 20), CountingModel(folder, kill_on="p7"), path, **options())
    first = noted(folder, "end")
    assert 0 < len(first) < 20 and "p7" not in first
    kept = {r.job_key for r in mj.stored_results(spark, path).collect()}
    assert kept == {f"T{p[1:]}" for p in first}             # every finished call is in the table already
    assert mj.run_calls(jobs(spark, 20), CountingModel(folder), path, **options()) == 20 - len(first)
    assert noted(folder, "end") == Counter({f"p{i}": 1 for i in range(20)})
    assert mj.run_calls(jobs(spark, 20), CountingModel(folder), path, **options()) == 0
    out = mj.finished_memos(jobs(spark, 21), path).collect()
    assert {r.ticker: r.investment_memo for r in out} == {f"T{i}": f"memo of p{i}" for i in range(20)} | {"T20": None}
    assert out[0].__fields__ == ["ticker", "prompt", "investment_memo", "generation_timestamp", "ok", "attempts"]


def test_calls_at_a_time_are_bounded(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    mj.run_calls(jobs(spark, 9), CountingModel(folder, seconds=0.3), str(tmp_path / "r"), **options(max_in_flight=3))
    events = sorted((int(n.split("-")[2]), 1 if n.startswith("start") else -1) for n in os.listdir(folder))
    at_once, most = 0, 0
    for _, step in events:
        at_once += step
        most = max(most, at_once)
    assert most <= 3 and noted(folder, "end").total() == 9


def test_failures_back_off_are_kept_and_asked_again(spark, tmp_path):
    folder, path = tmp_path / "calls", str(tmp_path / "r")
    folder.mkdir()
    flaky = CountingModel(folder, fail_times=2)
    mj.run_calls(jobs(spark, 2), flaky, path, **options(attempts=3, first_pause=0.01, sleep=time.sleep))
    assert {(r.ok, r.attempts) for r in mj.stored_results(spark, path).collect()} == {(True, 3)}
    broken = CountingModel(folder, fail_times=99)
    more = jobs(spark, 4)
    assert mj.run_calls(more, broken, path, **options()) == 2
    assert {r.memo for r in mj.stored_results(spark, path).where("NOT ok").collect()} == {"Error generating memo: busy"}
    assert mj.run_calls(more, broken, path, **options(retry_failed=False)) == 0
    assert mj.run_calls(more, CountingModel(folder), path, **options()) == 2
    assert mj.stored_results(spark, path).where("ok").count() == 4


def test_pauses_grow_to_the_longest():
    pauses = []

    def never(_):
        raise ValueError("no")
    assert mj.call_with_backoff(never, "x", 6, 2.0, 10.0, pauses.append) == ("Error generating memo: no", False, 6)
    assert len(pauses) == 5 and all(0.75 * b <= p <= 1.25 * b for p, b in zip(pauses, (2, 4, 8, 10, 10)))


def test_changed_prompts_repeats_and_missing_values(spark, tmp_path):
    folder, path = tmp_path / "calls", str(tmp_path / "r")
    folder.mkdir()
    model = CountingModel(folder)
    rows = [("A", "one"), ("A", "one"), ("A", "two"), (None, "three"), ("B", None)]
    df = spark.createDataFrame(rows, "ticker string, prompt string")
    assert mj.run_calls(df, model, path, **options()) == 2
    assert mj.run_calls(spark.createDataFrame([("A", "new")], "ticker string, prompt string"), model, path, **options()) == 1
    got = sorted(((r.ticker, r.prompt, r.investment_memo) for r in mj.finished_memos(df, path).collect()), key=repr)
    assert got == sorted([("A", "one", "memo of one")] * 2 + [("A", "two", "memo of two"), (None, "three", None), ("B", None, None)], key=repr)
    empty = spark.createDataFrame([], "ticker string, prompt string")
    assert mj.run_calls(empty, model, str(tmp_path / "none"), **options()) == 0
    assert mj.finished_memos(empty, str(tmp_path / "none")).collect() == []
