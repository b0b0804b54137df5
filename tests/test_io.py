"""Readers, sinks and streams on files made here."""

import hashlib
import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.relational import Refused
from tidemark.sinks import publish as P
from tidemark.sources import files
from tidemark.streaming import jobs


def test_prices_reconcile_overlapping_reasons(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,10,11,9,10,100\n2024-01-03,10,9,11,10,100\n2024-01-03,10,11,9,10,100\n2024-01-06,10,11,9,10,1d\n,10,11,9,10,100\n")
    raw = spark.read.csv(str(tmp_path / "p.csv"), header=True)
    calendar = spark.createDataFrame([(date(2024, 1, 2), datetime(2024, 1, 2, 21)), (date(2024, 1, 3), datetime(2024, 1, 3, 21))], "session date, decision timestamp")
    prices = files.read_prices(raw, calendar)
    found = {(str(r["session"]), tuple(r["reasons"])) for r in prices.collect()}
    assert found == {("2024-01-02", ()), ("2024-01-03", ("duplicate_session", "invalid_ohlc")), ("2024-01-03", ("duplicate_session",)), ("2024-01-06", ("invalid_ohlc", "non_session")), ("None", ("invalid_date",))}
    assert dict(files.exclusion_counters(prices).collect()) == {"accepted": 1, "excluded": 4, "duplicate_session": 2, "invalid_ohlc": 2, "non_session": 1, "invalid_date": 1}
    typed = files.read_source_csv(spark, str(tmp_path / "p.csv"), ["Close", "Volume", "Dividends"])
    assert "Dividends" not in typed.columns and dict(typed.dtypes)["Close"] == "double" and typed.where("Volume is null").count() == 1
    assert files.compare_number_parsers(spark, str(tmp_path / "p.csv"), ["Volume"]).first()["lenient_only"] == 1
    with pytest.raises(Refused):
        files.read_prices(raw, calendar, 0.1)


def test_records_facts_inventory(spark, tmp_path):
    lines = [b'{"a": 1}\n', b'{"a": 1, "a": 2}\r\n', b"[1]\n", b"\xff\xfe\n", b'{"a": NaN}\n', b'{"big": "' + b"x" * 300 + b'"}']
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.jsonl").write_bytes(b"".join(lines))
    found = files.read_records(spark, str(tmp_path / "r"), 200).orderBy("ordinal").collect()
    assert [r["state"] for r in found] == ["accepted", "invalid_json", "invalid_record", "invalid_utf8", "invalid_json", "oversize"]
    assert [r["byte_offset"] for r in found] == [sum(map(len, lines[:i])) for i in range(6)] and found[5]["payload"] is None
    (tmp_path / "f.json").write_text(json.dumps({"facts": {"gaap": {"Assets": {"units": {"USD": [{"val": 5.0, "end": "2024-01-01", "filed": "2024-02-01", "accn": "1"}]}}}}}))
    assert files.read_facts(spark, str(tmp_path / "f.json")).select("namespace", "concept", "unit", "value").first() == ("gaap", "Assets", "USD", 5.0)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "i" / "b.json").write_text("[1]")
    (tmp_path / "i" / "c.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    first = files.inventory(spark, str(tmp_path / "i"))
    by = {r["kind"]: r for r in first.collect()}
    assert by["csv"]["columns"] == ["x", "y"] and by["json"]["is_array"] and (by["png"]["width"], by["png"]["height"]) == (7, 9)
    before = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "i" / "a.csv").write_text("x\n")
    (tmp_path / "i" / "b.json").unlink()
    assert {r["state"] for r in files.changed_files(before, files.inventory(spark, str(tmp_path / "i"))).collect()} == {"changed", "gone", "same"}


def test_small_readers(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01", 1.0, None), ("2024-02", None, 2.0)], "period string, v1 double, v2 double")
    assert sorted(map(tuple, files.vintage_matrix(wide, "period").collect())) == [("2024-01", "v1", 1.0), ("2024-02", "v2", 2.0)]
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert files.read_bounded(spark, str(tmp_path / "t"), 10).count() == 10
    with pytest.raises(Refused):
        files.read_bounded(spark, str(tmp_path / "t"), 9)
    html = '<html lang="en"><head><title>A &amp; B</title><link rel="canonical" href="/c"><script type="application/ld+json">{"datePublished": "2024-01-01"}</script></head><p>one</p><script>x="<p>no</p>"</script><p> two </p><a href="z">z</a>'
    r = files.parse_articles(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").orderBy("id").first()
    assert (r["title"], r["lang"], r["canonical"], r["published"], r["paragraphs"], r["links"]) == ("A & B", "en", "/c", "2024-01-01", 2, 1)


def test_publishing(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5), (2, 0.1)], "k int, v double")
    root = f"file://{tmp_path}"
    digest = P.publish(a, f"{root}/a")
    assert P.publish(a.repartition(3).orderBy(F.desc("k")), f"{root}/a") == digest
    with pytest.raises(Refused):
        P.publish(a.where("k = 1"), f"{root}/a")
    assert P.publish_by_content(a, f"{root}/by") == P.publish_by_content(a.repartition(2), f"{root}/by")
    shared, values = P.compact(a, ["k"], f"{root}/rows", f"{root}/values")
    assert sorted(map(tuple, P.read_compacted(spark, shared, values).collect())) == [(1, 0.5), (2, 0.1)]
    assert dict(P.narrow_doubles(a).dtypes)["v"] == "double" and dict(P.narrow_doubles(a.where("k = 1")).dtypes)["v"] == "float"
    for _ in range(2):
        P.append_batch(a, f"{root}/batches", 0)
    assert spark.read.parquet(f"{root}/batches").count() == 2
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


def test_stateful_stream_equals_the_batch(spark, sf_dir, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        s = jobs.event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("market"), F.date_trunc("day", "ts").alias("at"), F.col("event_id").alias("id"), F.abs(F.col("value") - 10).alias("error"))
        done = jobs.to_end(jobs.online_conformal(s), "append").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    days = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect():
        days.setdefault(r["event_type"], {}).setdefault(r["ts"].date(), []).append(abs(r["value"] - 10))
    for market, by in days.items():
        correction, want, before = 0.0, [], None
        for day in sorted(by):
            if before is not None:
                correction += 0.5 * ((before > want[-1]) - 0.1)
            want.append(2.0 + correction)
            before = sum(by[day]) / len(by[day])
        got = [r["radius"] for r in sorted((r for r in done if r["market"] == market), key=lambda r: r["at"])]
        assert got == pytest.approx(want)


def test_records_of_a_file_read_in_many_splits(spark, tmp_path):
    lines = [b'{"i": %d, "x": "%s"}' % (i, b"y" * (i % 37)) + (b"\r\n" if i % 5 == 0 else b"\n") for i in range(3000)]
    lines[-1] = lines[-1].rstrip()
    (tmp_path / "x.jsonl").write_bytes(b"".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.read_records(spark, str(tmp_path / "x.jsonl"))
        found = df.orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["ordinal"] for r in found] == list(range(3000)) and {r["state"] for r in found} == {"accepted"}
    assert [r["byte_offset"] for r in found] == [sum(map(len, lines[:i])) for i in range(3000)]
    assert [r["byte_length"] for r in found] == list(map(len, lines))
    assert [r["raw_sha256"] for r in found[-7:]] == [hashlib.sha256(x).hexdigest() for x in lines[-7:]]
    assert [r["record_sha256"] for r in found[:7]] == [hashlib.sha256(x.rstrip(b"\r\n")).hexdigest() for x in lines[:7]]


def test_arrays_parts_and_release_tables(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"code": "1", "assets": 5.0, "odd": 1}, {"code": "2", "assets": null}, {"code": "x", "assets": "n/a"}]')
    rows, census = files.read_json_array(spark, str(tmp_path / "b.json"), ["code", "assets"])
    assert rows.columns == ["code", "assets"] and rows.count() == 3
    assert {r["field"]: (r["rows"], r["present"], r["numbers"]) for r in census.collect()} == {"code": (3, 3, 2), "assets": (3, 2, 1)}
    (tmp_path / "parts").mkdir()
    for n in (0, 1):
        spark.range(3).toPandas().to_parquet(tmp_path / "parts" / f"part-{n:05d}.parquet")
    assert files.read_parts(spark, str(tmp_path / "parts")).groupBy("part").count().count() == 2
    spark.range(3).toPandas().to_parquet(tmp_path / "parts" / "part-00003.parquet")
    with pytest.raises(Refused):
        files.read_parts(spark, str(tmp_path / "parts"))
    html = "<p>Released 2024-03-05</p><table><tr><th>Item</th><th>Jan</th><th>Feb</th></tr><tr><td>Retail <b>sales</b></td><td>1.50</td><td>-2</td></tr><tr></tr></table>"
    pages = spark.createDataFrame([(1, html, date(2024, 3, 7)), (2, html + "2024-03-06", date(2024, 3, 1)), (3, None, None)], "id int, html string, seen date")
    found = sorted(map(tuple, files.release_tables(pages, "id", "html", r"(\d{4}-\d{2}-\d{2})", "seen").collect()), key=repr)
    assert found[0] == (1, date(2024, 3, 5), 0, "Retail sales", "Feb", "-2", date(2024, 3, 7)) and len(found) == 4
    assert all(r[1] is None and r[6] is None for r in found if r[0] == 2)


def test_formats(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "x")
    cases = {"a.csv": (b"x,y\n1,2\n", "valid"), "b.csv": (b"x,y\n1\n", "ragged"), "c.json": (b'{"a": 1, "a": 2}', "invalid"), "d.xml": (b"<a><b/></a>", "valid"), "e.xml": (b"<!DOCTYPE a [<!ENTITY x 'y'>]><a/>", "refused"), "f.zip": (packed.getvalue(), "valid"), "g.xlsx": (packed.getvalue(), "invalid"), "h.zip": (b"PK", "invalid"), "i.pdf": (b"%PDF-1.4 %%EOF", "valid"), "j.bin": (b"", "unknown")}
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "path string, content binary")
    assert {r["path"]: r["state"] for r in files.validate_formats(df).collect()} == {k: v[1] for k, v in cases.items()}


def test_manifests_cohorts_and_aggregates(spark, tmp_path):
    a, root = spark.createDataFrame([(1, 0.5), (2, 0.1)], "k int, v double"), f"file://{tmp_path}"
    digest = P.write_with_manifest(a, f"{root}/tape", {"market": "x"})
    rows, manifest = P.read_with_manifest(spark, f"{root}/tape")
    assert rows.count() == 2 and manifest["digest"] == digest and manifest["about"] == {"market": "x"}
    P.atomic_json(spark, f"{root}/tape/manifest.json", manifest | {"digest": "0"})
    with pytest.raises(Refused):
        P.read_with_manifest(spark, f"{root}/tape")
    receipt = P.write_cohort(a.where("k = 1"), a.where("k = 2"), f"{root}/cohort")
    assert P.read_json(spark, f"{root}/cohort/receipt.json") == receipt and spark.read.parquet(f"{root}/cohort/excluded").first()["k"] == 2
    assert P.write_aggregates(a, f"{root}/windows", {"w": 1}) == P.write_aggregates(a.repartition(3), f"{root}/windows", {"w": 1}) != P.write_aggregates(a, f"{root}/windows", {"w": 2})
    P.write_large(a, f"{root}/large")
    assert spark.read.parquet(f"{root}/large").count() == 2
