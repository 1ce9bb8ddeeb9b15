from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

import fixtures
from conftest import rows
from fundtrace import schemas
from fundtrace.operators import resolve
from fundtrace.streaming import findings, ingest, validate

GOOD = {
    "_id": "101",
    "recipient_legal_name": "Northern Pathways Community Society",
    "recipient_business_number": "123456789",
    "agreement_value": "250000",
}
BAD = {"recipient_legal_name": "Missing Identifier Society", "agreement_value": "100000"}


def put(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(i) for i in items))


@pytest.fixture()
def feed(tmp_path):
    return ingest.Feed("fed_grants", str(tmp_path / "in"), str(tmp_path / "out"))


def table(spark, feed, name):
    return spark.read.parquet(f"{feed.out}/{name}")


def test_validation_rules(spark):
    def outcome(source, item):
        names = {f.name for f in spark.createDataFrame([], schemas.FEED).schema}
        df = spark.createDataFrame([tuple(item.get(c) for c in sorted(names))], ", ".join(f"`{c}` string" for c in sorted(names)))
        return validate.checked(df, source, F.lit("b")).first()["_errors"]

    assert outcome("fed_grants", GOOD) == []
    assert outcome("fed_grants", BAD) == ["_id is required"]
    assert outcome("fed_grants", {"_id": "1", "agreement_value": "abc"}) == ["agreement_value must be a number"]
    assert outcome("fed_grants", {"_id": "1", "agreement_value": ""}) == []
    assert outcome("cra_t3010", {"_id": "1", "BN": " "}) == ["BN is required"]
    assert outcome("cra_donees", {"_id": " ", "Total Gifts": "x"}) == [
        "_id is required",
        "Total Gifts must be a number",
    ]
    assert outcome("something_else", {}) == []
    no_bn = spark.createDataFrame([("1",)], "_id string")
    assert validate.checked(no_bn, "cra_t3010", F.lit("b")).first()["_errors"] == []


def test_batch_from_feed_to_finding(spark, feed, tmp_path):
    wh = fixtures.three_entities(spark)
    put(tmp_path / "in", "a.json", GOOD, BAD)
    assert ingest.run_cycle(spark, [feed], wh, str(tmp_path / "cp")) == {"fed_grants": None}
    ledger = table(spark, feed, "ledger").first()
    assert (ledger["raw_row_count"], ledger["valid_row_count"], ledger["quarantined_row_count"]) == (2, 1, 1)
    held = table(spark, feed, "quarantine").first()
    assert held["external_id"] is None and "_id is required" in held["error"]
    assert json.loads(held["raw_row"])["recipient_legal_name"] == "Missing Identifier Society"
    finding = table(spark, feed, "findings").first()
    assert finding["ring_id"] == "cra-cycle-1" and finding["finding_type"] == "new_ring"
    assert finding["mapping_method"] == "bn_root" and finding["confidence_score"] == 1.0
    assert finding["batch_id"] == "fed_grants-0" and len(finding["trigger_row_hash"]) == 64
    assert finding["entity_ids"] == [1001, 1002] and finding["review_status"] == "pending"
    assert finding["severity"] == "review"
    assert "$250,000 to Northern Pathways Community Society" in finding["narrative"]


def test_replay_gives_nothing_new_and_new_rows_expand(spark, feed, tmp_path):
    wh = fixtures.three_entities(spark)
    checkpoint = str(tmp_path / "cp")
    put(tmp_path / "in", "a.json", GOOD)
    ingest.run_cycle(spark, [feed], wh, checkpoint)
    put(tmp_path / "in", "b.json", GOOD)
    ingest.run_cycle(spark, [feed], wh, checkpoint)
    assert table(spark, feed, "findings").count() == 1
    assert table(spark, feed, "ledger").agg(F.sum("raw_row_count")).first()[0] == 1
    put(tmp_path / "in", "c.json", {**GOOD, "_id": "102", "agreement_value": "2000000"})
    ingest.run_cycle(spark, [feed], wh, checkpoint)
    kinds = rows(table(spark, feed, "findings"), "finding_type", "severity")
    assert kinds == [("expanded_ring", "urgent"), ("new_ring", "review")]
    state = validate.source_state(table(spark, feed, "source_progress")).first()
    assert state["last_cursor"] == 102 and state["rows_fetched_total"] == 2


def test_replayed_batch_overwrites_its_own_output(spark, feed):
    wh = fixtures.three_entities(spark)
    index = resolve.build_index(wh)
    data = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    for _ in range(2):
        ingest.process_batch(data, 3, feed, wh, index)
    assert rows(table(spark, feed, "findings"), "finding_type") == [("new_ring",)]


LINES = [
    json.dumps(GOOD),
    json.dumps({**GOOD, "agreement_value": "300000", "programme": "arts"}),
    json.dumps({**GOOD, "_id": " ", "note": "first"}),
    json.dumps({**GOOD, "_id": " ", "note": "second"}),
    json.dumps({**BAD, "extra": 1}),
    json.dumps({**BAD, "extra": 2}),
    "{broken",
    "{broken",
]


def stored(spark, feed, name, drop=("created_at", "fetched_at", "run_at")):
    df = table(spark, feed, name)
    return rows(df.drop(*drop), *sorted(set(df.columns) - set(drop)))


def test_no_row_of_a_batch_is_lost(spark, tmp_path):
    wh = fixtures.three_entities(spark)
    feed = ingest.Feed("fed_grants", str(tmp_path / "in"), str(tmp_path / "out"), resource_id="resource-1", source_url="https://example.org/feed")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(LINES))
    assert ingest.run_cycle(spark, [feed], wh, str(tmp_path / "cp")) == {"fed_grants": None}
    ledger = table(spark, feed, "ledger").first()
    assert (ledger["raw_row_count"], ledger["valid_row_count"], ledger["quarantined_row_count"]) == (8, 2, 6)
    assert ledger["resource_id"] == "resource-1" and ledger["fetched_at"] is not None
    held = sorted(r["raw_row"] for r in table(spark, feed, "quarantine").collect())
    assert held == sorted(LINES[2:])
    (finding,) = table(spark, feed, "findings").collect()
    # The last row of an id counts, in the order of the file.
    assert finding["total_amount"] and "$300,000" in finding["narrative"]
    assert (finding["resource_id"], finding["source_url"]) == ("resource-1", "https://example.org/feed")
    # A replay of the batch adds nothing; neither do the same ids in a later file.
    (tmp_path / "in" / "b.json").write_text(LINES[0])
    ingest.run_cycle(spark, [feed], wh, str(tmp_path / "cp"))
    assert table(spark, feed, "ledger").agg(F.sum("raw_row_count")).first()[0] == 8


def test_batch_operators_and_stream_agree(spark, tmp_path):
    wh = fixtures.three_entities(spark)
    feed = ingest.Feed("fed_grants", str(tmp_path / "in"), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(LINES))
    ingest.run_cycle(spark, [feed], wh, str(tmp_path / "cp"))
    lines = spark.read.text(feed.inbox).withColumn("_order", F.monotonically_increasing_id())
    checked = validate.checked(validate.parse_feed(lines), "fed_grants", F.lit("fed_grants-0"))
    good = validate.valid_rows(checked)
    index = resolve.build_index(wh)
    found = findings.analyze(
        wh, good, resolve.resolve_rows(good, "fed_grants", index, "_order"), index, "fed_grants",
        spark.createDataFrame([], "ring_id string"), order="_order",
    )
    for name, df in {
        "quarantine": validate.quarantine(checked, "fed_grants"), "ledger": validate.ledger(checked, "fed_grants"), "findings": found,
    }.items():
        columns = sorted(df.columns)
        assert rows(table(spark, feed, name), *columns) == rows(df, *columns)


def test_fields_of_a_line(spark):
    items = [{"_id": 7, "Donee BN": "1"}, {"_id": "8", "BN": None}, {"_id": "9", "BN": " "}, {"_id": "10", "BN": "123"}]
    lines = spark.createDataFrame([(json.dumps(i),) for i in items], "value string")
    checked = validate.checked(validate.parse_feed(lines), "cra_t3010", F.lit("b"))
    assert rows(checked, "_id", "_errors") == [("10", []), ("7", []), ("8", ["BN is required"]), ("9", ["BN is required"])]
    donee = spark.createDataFrame([('{"_id":"1","total_gifts":"5000"}',), ('{"_id":"2","Total Gifts":"12d"}',), ('{"_id":"3","Total Gifts":"0x1p3"}',)], "value string")
    donee = validate.checked(validate.parse_feed(donee), "cra_donees", F.lit("b"))
    assert rows(donee, "_id", F.size("_errors")) == [("1", 0), ("2", 1), ("3", 1)]
    assert rows(donee.select("_id", findings.feed_amount(donee, "cra_donees").alias("a")).filter("a > 0")) == [("1", 5000.0)]
    # The order of fields does not matter to the hash, an extra field does.
    hashes = [validate.checked(validate.parse_feed(spark.createDataFrame([(t,)], "value string")), "x", F.lit("b")).first()["_row_hash"] for t in ('{"a":1,"_id":"2"}', '{"_id": "2", "a": 1}', '{"_id":"2"}')]
    assert hashes[0] == hashes[1] != hashes[2]


def test_a_cycle_leaves_no_intermediate_table(spark, feed, tmp_path):
    from fundtrace import session

    folder = session.checkpoint_folder(spark).removeprefix("file:")
    wh = fixtures.three_entities(spark)
    before = set(os.listdir(folder))
    put(tmp_path / "in", "a.json", GOOD, BAD)
    ingest.run_cycle(spark, [feed], wh, str(tmp_path / "cp"))
    assert {n for n in os.listdir(folder) if n.startswith("table-")} <= before


def test_known_rings_of_any_age(spark, feed):
    wh = fixtures.three_entities(spark)
    index = resolve.build_index(wh)
    for prior, batch in ((None, 1), (0, 2)):
        one = ingest.Feed(feed.source, feed.inbox, feed.out, prior_findings=prior)
        ingest.process_batch(spark.createDataFrame([(json.dumps({**GOOD, "_id": str(batch)}),)], "value string"), batch, one, wh, index)
    kinds = rows(table(spark, feed, "findings"), "batch", "finding_type")
    assert kinds == [(1, "new_ring"), (2, "new_ring")]
    everything = ingest.Feed(feed.source, feed.inbox, feed.out, prior_findings=None)
    ingest.process_batch(spark.createDataFrame([(json.dumps({**GOOD, "_id": "3"}),)], "value string"), 3, everything, wh, index)
    assert (3, "expanded_ring") in rows(table(spark, feed, "findings"), "batch", "finding_type")


def test_readers_see_whole_batches_only(spark, feed, tmp_path, monkeypatch):
    """A batch that fails after some of its tables leaves nothing to read, its retry is whole, and other feeds go on."""
    wh = fixtures.three_entities(spark)
    index = resolve.build_index(wh)
    other = ingest.Feed("cra_t3010", feed.inbox, feed.out)
    line = lambda k: spark.createDataFrame([(json.dumps({**GOOD, "_id": k}),)], "value string")
    ingest.process_batch(line("1"), 0, feed, wh, index)
    with monkeypatch.context() as patch:
        patch.setattr(ingest.finding_ops, "analyze", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.process_batch(line("2"), 1, feed, wh, index)
    read = lambda name: rows(ingest.read_table(spark, feed.out, name, "x int"), "feed", "batch")
    # The failed attempt's folders are there, but unpublished.
    assert spark.read.parquet(f"{feed.out}/ledger").count() == 2
    assert read("ledger") == [("fed_grants", 0)]
    ingest.process_batch(line("3"), 0, other, wh, index)
    ingest.process_batch(line("2"), 1, feed, wh, index)
    assert read("ledger") == [("cra_t3010", 0), ("fed_grants", 0), ("fed_grants", 1)]
    assert rows(ingest.read_table(spark, feed.out, "seen", "external_id string"), "external_id") == [("1",), ("2",), ("3",)]
    # Replays of published batches add nothing.
    ingest.process_batch(line("9"), 1, feed, wh, index)
    assert read("ledger") == [("cra_t3010", 0), ("fed_grants", 0), ("fed_grants", 1)]


def test_loops_beyond_the_limit(spark, feed):
    """A feed looks at its ``loops`` largest loops; None at all of them."""
    wh = fixtures.three_entities(spark)
    index = resolve.build_index(wh)
    data = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    for k, (limit, found) in enumerate([(0, 0), (None, 1)]):
        one = ingest.Feed(feed.source, feed.inbox, f"{feed.out}-{k}", loops=limit)
        ingest.process_batch(data, 0, one, wh, index)
        assert ingest.read_table(spark, one.out, "findings", schemas.FINDING).count() == found


def test_one_failing_feed_does_not_stop_the_others(spark, feed, tmp_path):
    wh = fixtures.three_entities(spark)
    put(tmp_path / "in", "a.json", GOOD)
    broken = ingest.Feed("cra_t3010", str(tmp_path / "absent"), str(tmp_path / "out"))
    outcome = ingest.run_cycle(spark, [broken, feed], wh, str(tmp_path / "cp"))
    assert outcome["fed_grants"] is None and outcome["cra_t3010"]


def analysed(spark, items, prior=()):
    wh = fixtures.three_entities(spark)
    index = resolve.build_index(wh)
    names = ("_id", "recipient_legal_name", "recipient_business_number", "agreement_value")
    data = spark.createDataFrame([tuple(i.get(c) for c in names) + (None,) * 4 for i in items], schemas.FEED)
    good = validate.valid_rows(validate.checked(data, "fed_grants", F.lit("b")))
    seen = spark.createDataFrame([(p,) for p in prior], "ring_id string")
    found = resolve.resolve_rows(good, "fed_grants", index)
    return findings.analyze(wh, good, found, index, "fed_grants", seen).collect()


def test_largest_trigger_wins_and_noise_is_skipped(spark):
    items = [
        {**GOOD, "_id": "1", "agreement_value": "999"},
        {**GOOD, "_id": "2", "agreement_value": "5000"},
        {**GOOD, "_id": "3", "agreement_value": "7000", "recipient_business_number": "234567890"},
    ]
    (found,) = analysed(spark, items, prior=["cra-cycle-1"])
    assert (found["trigger_external_id"], found["finding_type"]) == ("3", "expanded_ring")
    assert found["entity_ids"] == [1002, 1001]
    assert analysed(spark, items[:1]) == []


def test_zero_amount_is_kept(spark):
    (found,) = analysed(spark, [{**GOOD, "agreement_value": None}])
    assert found["total_amount"] == 179000
