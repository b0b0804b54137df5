"""Every command of the command line on files made here."""

import json
from datetime import datetime

import pytest

from tidemark.__main__ import COMMANDS, main


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


@pytest.fixture
def call(spark, capsys):
    def run(*argv):
        capsys.readouterr()
        main(list(map(str, argv)), spark)
        return lines(capsys)

    return run


def test_corpus(spark, call, tmp_path):
    (tmp_path / "src").mkdir()
    body = {"Asset": "a.sh", "Title": "T", "Date": "2024-01-02", "Body": "one two"}
    (tmp_path / "src" / "a.sh.jsonl").write_text("".join(json.dumps(r) + "\n" for r in (body, body | {"Title": "U"}, body | {"Body": "one"})) + "[1]\n")
    found = call("inventory", tmp_path / "src", f"file://{tmp_path}/inv")
    assert found[0]["files"] == 1 and "digest" in found[-1]
    assert call("inventory", tmp_path / "src", f"file://{tmp_path}/inv2", "--previous", f"file://{tmp_path}/inv")[1] == {"files": 1, "state": "same"}
    assert {r["state"]: r["records"] for r in call("corpus-index", tmp_path / "src", f"file://{tmp_path}/index")} == {"accepted": 3, "invalid_record": 1}
    assert call("corpus-status", f"file://{tmp_path}/index")[0]["records"] == 4
    page = call("news-queue", f"file://{tmp_path}/index", "--size", 2)
    assert [r["ordinal"] for r in page] == [0, 1] and page[0]["asset"] == "A.SS"
    assert [r["ordinal"] for r in call("news-queue", f"file://{tmp_path}/index", "--after-path", page[1]["path"], "--after-ordinal", 1)] == [2]
    (tmp_path / "evidence.jsonl").write_text(json.dumps(body) + "\n")
    states = {r["state"]: r["records"] for r in call("news-verify", f"file://{tmp_path}/index", tmp_path / "evidence.jsonl", f"file://{tmp_path}/verdicts")}
    assert states == {"same_body": 1, "title_differs": 1, "contained_body": 1}
    assert any(r["records"] == 3 for r in call("news-status", f"file://{tmp_path}/verdicts"))
    assert call("news-queue", f"file://{tmp_path}/index", "--verdicts", f"file://{tmp_path}/verdicts") == []


def test_prices_and_panels(spark, call, tmp_path, sf_dir):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,10,11,9,10,100\n2024-01-03,10,9,11,10,1e2f\n")
    spark.createDataFrame([("2024-01-02", datetime(2024, 1, 2, 21)), ("2024-01-03", datetime(2024, 1, 3, 21))], "session string, decision timestamp").write.parquet(f"file://{tmp_path}/calendar")
    assert call("audit-prices", tmp_path / "p.csv", f"file://{tmp_path}/calendar")[0] == {"counter": "accepted", "rows": 1}
    assert call("prepare", tmp_path / "p.csv", f"file://{tmp_path}/calendar", f"file://{tmp_path}/asset")[0]["accepted"].startswith("1-")
    assert call("verify-number-parsing", tmp_path / "p.csv", "Close,Volume")[1]["lenient_only"] == 1
    spark.createDataFrame([("a", f"s{i % 2}", float(i)) if i else ("b", "s0", 0.0) for i in range(3)] + [(f"c{i}", "s1", 5.0) for i in range(9)], "asset string, sector string, size double").write.parquet(f"file://{tmp_path}/census")
    assert len(call("select", f"file://{tmp_path}/census", "--per-sector", 2)) == 4
    rows = [("i", "2024-01", datetime(2024, 2, 1), 1.0), ("i", "2024-01", datetime(2024, 2, 3), 2.0), ("i", "2024-02", datetime(2024, 3, 1), 3.0)]
    spark.createDataFrame(rows, "indicator string, period string, available timestamp, value double").write.parquet(f"file://{tmp_path}/vintages")
    assert call("macro", f"file://{tmp_path}/vintages", f"file://{tmp_path}/panel")[0]["changes"] == 3
    assert sum(r["decisions"] for r in call("encode", sf_dir, f"file://{tmp_path}/samples")) > 0
    assert call("profile", "session_metrics", sf_dir, "--runs", 1)[0]["query"] == "session_metrics"
    assert len(call("run", "status_rollup", sf_dir, "--most", 3)) == 3
    assert set(COMMANDS) >= {"inventory", "corpus-index", "corpus-status", "news-queue", "news-status", "news-verify", "select", "prepare", "audit-prices", "verify-number-parsing", "macro", "encode", "profile"}
