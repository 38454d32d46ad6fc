"""The judge's streaming run: each key once, interrupted runs go on, failed calls are tried again."""

import pytest
from pyspark.sql import functions as F

from prismet.operators.graph import shared
from prismet.plans import pipelines
from prismet.streaming import judging


@pytest.fixture
def tables(spark):
    pairs = [(f"i{k % 40}", f"claim {k % 25}", f"report {k}") for k in range(130)]
    ex = spark.createDataFrame([(i, p) for i, p, _ in pairs], "image_id string, pseudo_report string")
    rep = spark.createDataFrame(sorted({(i, f"report of {i}") for i, _, _ in pairs}), "image_id string, report string")
    return ex, rep, len({(i, p) for i, p, _ in pairs})


def counted(folder, spark, fail=None):
    """A model that leaves a file a call, so that calls in any worker are counted; it fails where the prompt holds `fail`."""
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)

    def model(prompt):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if fail and fail in prompt:
            raise RuntimeError("down")
        return "fine | Verdict: Aligned"

    return model, lambda: len(os.listdir(folder))


def test_each_key_is_called_once_and_resumed_runs_call_nothing(spark, tables, tmp_path):
    ex, rep, n = tables
    model, calls = counted(str(tmp_path / "calls"), spark)
    run = lambda resume: pipelines.judged_in_parts(spark, ex, rep, model, "{report}{pseudo_report}", str(tmp_path / "out"), 7, resume)
    s = run(False)
    assert calls() == n and s["records"].count() == n and s["scores"].first()["aligned"] == n
    assert run(True)["records"].count() == n and calls() == n
    assert run(False)["records"].count() == n and calls() == 2 * n


def test_failed_calls_are_tried_again(spark, tables, tmp_path):
    ex, rep, n = tables
    bad, calls = counted(str(tmp_path / "a"), spark, "report of i3claim")
    s = pipelines.judged_in_parts(spark, ex, rep, bad, "{report}{pseudo_report}", str(tmp_path / "out"), 50, False)
    broken = ex.where("image_id = 'i3'").distinct().count()
    assert s["scores"].first()["n_errors"] == broken > 0
    good, again = counted(str(tmp_path / "b"), spark)
    s = pipelines.judged_in_parts(spark, ex, rep, good, "{report}{pseudo_report}", str(tmp_path / "out"), 50, True)
    assert again() == broken and s["records"].count() == n and s["scores"].first()["n_errors"] == 0


def test_an_interrupted_run_goes_on_from_the_ledger(spark, tables, tmp_path):
    ex, rep, n = tables
    pairs = ex.join(rep, "image_id")
    opened, path = str(tmp_path / "open"), str(tmp_path / "ledger")
    model, calls = counted(str(tmp_path / "calls"), spark)
    judging.begin(spark, path)
    judging.write_open(pairs, judging.ledger(spark, path), opened, 5)

    stop = {"after": 2}
    ask = judging.judge.ask

    def some(*args):
        stop["after"] -= 1
        if stop["after"] < 0:
            raise RuntimeError("the driver is gone")
        return ask(*args)

    judging.judge.ask = some
    try:
        with pytest.raises(Exception, match="the driver is gone"):
            judging.run(spark, opened, path, "{report}{pseudo_report}", model, files=3)
    finally:
        judging.judge.ask = ask
    done = judging.ledger(spark, path).count()
    assert 0 < done < n and calls() == done
    judging.write_open(pairs, judging.ledger(spark, path), opened, 5)
    assert judging.run(spark, opened, path, "{report}{pseudo_report}", model, files=1000) == 1
    records = judging.ledger(spark, path)
    assert records.count() == records.select("image_id", "pseudo_report").distinct().count() == n == calls()


def test_no_open_pairs(spark, tmp_path):
    none = spark.createDataFrame([], judging.PAIRS)
    judging.write_open(none, judging.ledger(spark, str(tmp_path / "l")), str(tmp_path / "o"), 5)
    judging.run(spark, str(tmp_path / "o"), str(tmp_path / "l"), "{report}", lambda p: "x")
    assert judging.ledger(spark, str(tmp_path / "l")).count() == 0 and shared(spark) and F


def test_a_batch_meets_no_more_of_the_ledger_than_its_own_keys(spark, tmp_path, monkeypatch):
    opened, path = str(tmp_path / "open"), str(tmp_path / "ledger")
    spark.createDataFrame([(f"old{k}", "claim", "Aligned", "x") for k in range(50)] + [("i3", "claim", "Aligned", "x")], judging.RECORDS).write.parquet(f"{path}/run=a")
    spark.createDataFrame([(f"i{k}", "claim", "report") for k in range(9)], judging.PAIRS).write.parquet(opened)
    met, pending = [], judging.judge.pending
    monkeypatch.setattr(judging.judge, "pending", lambda pairs, records, *more: met.append(records.count()) or pending(pairs, records, *more))
    judging.run(spark, opened, path, "{report}", lambda p: "Supports", files=1000)
    assert met == [1] and judging.ledger(spark, path).count() == 51 + 8
