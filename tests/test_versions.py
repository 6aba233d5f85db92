import json
import random

import pytest
from pyspark.sql import functions as F

from pricewell.operators import incremental, intervals, signals
from pricewell.plans import fixtures as X
from pricewell.sources import nested, snapshots

OBS = "material_id string, period string, value double"


def months(n, start=24000):
    return [f"{(start + i) // 12:04d}-{(start + i) % 12 + 1:02d}" for i in range(n)]


def new_log(spark, **options):
    return snapshots.Log(spark, X.scratch(spark), **options)


def stamped(spark, rows, at):
    return spark.createDataFrame(rows, OBS).withColumn("loaded_at", F.lit(at))


def rows_of(df):
    return sorted((r.material_id, r.period, r.value) for r in df.collect())


# nested documents


def source_docs(spark, rows, materials, parts=None):
    entries = nested.source_entries(spark.createDataFrame(rows, OBS), spark.createDataFrame(materials, "material_id string, name string, is_derived boolean"))
    return nested.documents(nested.SOURCE, entries, nested.source_head(entries, "primary"), "now", parts)


def test_documents_come_back_with_nulls(spark):
    rows = [("a", "2020-02", 1e-300), ("a", "2020-01", 0.1 + 0.2), ("b", "2020-01", None), ('q"\n', "2020-01", 7.0)]
    materials = [("a", None, None), ("b", "B", True), ('q"\n', " ", False), ("unseen", "U", None)]
    place = X.scratch(spark)
    run = nested.write_run(nested.SOURCE, source_docs(spark, rows, materials, 3), place)
    docs = nested.read_run(nested.SOURCE, spark, place, run)
    assert docs.count() == 3 and {r.dataset.observationCount for r in docs.collect()} == {4}
    assert sorted((r.material_id, r.period, r.value or -1) for r in nested.observations_of(docs).collect()) == sorted((m, p, v or -1) for m, p, v in rows)
    e = {r.material_id: r.entry for r in nested.entries_of(nested.SOURCE, docs).collect()}
    assert set(e) == {"a", "b", 'q"\n'} and e["a"].name == "a" and e["a"].attribution is None and e["a"].isDerived is False and e["b"].isDerived
    assert [o.period for o in e["a"].observations] == ["2020-01", "2020-02"] and e["a"].currency == "USD"


def test_no_entries_make_one_empty_document(spark):
    place = X.scratch(spark)
    run = nested.write_run(nested.SOURCE, source_docs(spark, [], [("a", None, None)]), place)
    only = nested.read_run(nested.SOURCE, spark, place, run).first()
    assert only.series == {} and only.dataset.seriesCount == 0 and only.dataset.latestPeriod is None
    assert nested.manifest(spark, place).collect()[0].n_entries == 0


def test_runs_are_read_as_the_manifest_says(spark, tmp_path):
    place, rows = str(tmp_path), [(m, p, 1.0) for m in "abcdef" for p in months(3)]
    materials = [(m, m.upper(), None) for m in "abcdef"]
    first = nested.write_run(nested.SOURCE, source_docs(spark, rows, materials, 2), place)
    second = nested.write_run(nested.SOURCE, source_docs(spark, rows[:3], materials, 1), place)
    told = {(r.run, r.part): r.n_entries for r in nested.manifest(spark, place).collect()}
    assert {k[0] for k in told} == {first, second} and sum(n for (run, _), n in told.items() if run == first) == 6
    assert nested.entries_of(nested.SOURCE, nested.read_run(nested.SOURCE, spark, place, second)).count() == 1
    file = next((tmp_path / "source" / f"run={first}").glob("part=1/*.txt"))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    file.write_text(file.read_text().replace("1.0", "2.0", 1))
    with pytest.raises(Exception, match="not as the manifest says: part 1"):
        nested.entries_of(nested.SOURCE, nested.read_run(nested.SOURCE, spark, place, first)).collect()
    with pytest.raises(Exception, match="not a source document of version 1"):
        nested.parsed(nested.SOURCE, spark.createDataFrame([(json.dumps({"schemaVersion": 2, "series": {}}),)], "value string")).collect()


def test_documents_follow_the_number_of_entries(spark, monkeypatch):
    monkeypatch.setattr(nested, "ENTRIES", 4)
    rows = [(f"m{i}", "2020-01", float(i)) for i in range(30)]
    docs = source_docs(spark, rows, [(m, None, None) for m, *_ in rows]).collect()
    assert len(docs) == 8 and sum(r.n_entries for r in docs) == 30


# snapshots


def test_the_last_row_of_a_key_counts(spark):
    log = new_log(spark)
    assert log.read() is None and log.last().number == 0
    log.append(stamped(spark, [("a", "2020-01", 1.0), ("a", "2020-02", 2.0), ("b", "2020-01", 3.0)], 1))
    log.append(stamped(spark, [("a", "2020-01", 9.0)], 2))
    log.append(stamped(spark, [("b", "2020-01", None)], 3).withColumn("removed", F.lit(True)))
    assert rows_of(log.read()) == [("a", "2020-01", 9.0), ("a", "2020-02", 2.0)]
    assert rows_of(log.read(2)) == [("a", "2020-01", 9.0), ("a", "2020-02", 2.0), ("b", "2020-01", 3.0)]
    assert [(r.material_id, r.period, r.old_value, r.new_value, r.change) for r in snapshots.history_between(log, 1, 3).orderBy("material_id").collect()] == [("a", "2020-01", 1.0, 9.0, "revised"), ("b", "2020-01", 3.0, None, "removed")]
    with pytest.raises(ValueError, match="loaded_at"):
        log.append(spark.createDataFrame([("a", "x", 1.0)], OBS))
    with pytest.raises(LookupError):
        log.snapshot(9)


def test_two_writers_take_two_numbers(spark):
    path = X.scratch(spark)
    one, two = snapshots.Log(spark, path), snapshots.Log(spark, path)
    stale = one.last()
    two.append(stamped(spark, [("a", "2020-01", 1.0)], 1))
    mine = one._written(stamped(spark, [("b", "2020-01", 2.0)], 1))
    got = one._commit(stale, lambda now: snapshots.replace(now, folders=(*now.folders, mine)))
    assert got.number == 2 and rows_of(one.read()) == rows_of(two.read()) == [("a", "2020-01", 1.0), ("b", "2020-01", 2.0)]
    assert not one._put("log/0000000002.json", "{}", overwrite=False) and two.last().folders == got.folders
    two._put("log/pointer", "1", overwrite=True)  # behind
    assert one.last().number == 2


def test_compaction_in_place(spark, monkeypatch):
    log = new_log(spark)
    for i in range(3):
        log.append(stamped(spark, [("a", p, float(i)) for p in months(i + 1)], i))
    before, written = log.read(), log._written
    base = rows_of(before)

    def interrupted(rows):  # another writer appends while the compaction writes
        name = written(rows)
        monkeypatch.setattr(log, "_written", written)
        log.append(stamped(spark, [("z", "2020-01", 5.0)], 9))
        return name

    monkeypatch.setattr(log, "_written", interrupted)
    new = log.compact()
    assert len(new.folders) == 2 and new.action == "compact" and new.number == 5
    assert rows_of(log.read()) == sorted([*base, ("z", "2020-01", 5.0)]) and rows_of(before) == base == rows_of(log.read(3))
    gone = log.expire(1)
    assert len(gone) == 3 and [s.number for s in log.snapshots()] == [5] and rows_of(log.read()) == sorted([*base, ("z", "2020-01", 5.0)])
    with pytest.raises(LookupError):
        log.read(3)


def test_compaction_gives_way_to_another(spark, monkeypatch):
    log = new_log(spark)
    for i in range(2):
        log.append(stamped(spark, [("a", "2020-01", float(i))], i))
    written = log._written

    def interrupted(rows):
        monkeypatch.setattr(log, "_written", written)
        log.compact()
        return written(rows)

    monkeypatch.setattr(log, "_written", interrupted)
    with pytest.raises(snapshots.Conflict):
        log.compact()
    assert rows_of(log.read()) == [("a", "2020-01", 1.0)]


def test_batches_come_once_and_folders_stay_few(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)
    log = new_log(spark)
    for i in (0, 1, 1, 0, 2, 3, 3, 4):
        log.append(stamped(spark, [("a", p, float(i)) for p in months(1, 24000 + i)], i), "s", i)
    assert [v for *_, v in rows_of(log.read())] == [0.0, 1.0, 2.0, 3.0, 4.0] and len(log.last().folders) <= 3 and log.last().batches == {"s": 4}


def test_a_gate_keeps_out_what_it_finds(spark):
    log = new_log(spark)
    gate = {"value": F.col("value") <= 0, "period": ~F.col("period").rlike("^[0-9]{4}-[0-9]{2}$")}
    assert log.replace(stamped(spark, [("a", "2020-01", 1.0)], 1), gate).number == 1
    for bad in [("a", "2020-01", -1.0), ("a", "2020", 1.0), ("a", "2020-01", None)]:  # what can't be judged is out too
        assert log.replace(stamped(spark, [("b", "2020-01", 1.0), bad], 1), gate) is None
    assert rows_of(log.read()) == [("a", "2020-01", 1.0)] and log.last().number == 1


def test_series_prune_what_is_read(spark):
    log = new_log(spark)
    log.append(stamped(spark, [(f"m{i}", "2020-01", float(i)) for i in range(40)], 1))
    log.append(stamped(spark, [("m7", "2020-01", 70.0)], 2))
    got = log.read(series=spark.createDataFrame([("m7",), ("m7",), ("none",)], "material_id string"))
    assert rows_of(got) == [("m7", "2020-01", 70.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("#", "") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


# intervals


def test_intervals_of_any_versions(spark):
    rng = random.Random(2)
    numbers = [1, 2, 5, 9, 10]
    versions = {v: {(m, p): rng.choice([1.0, 2.0, None]) for m in "ab" for p in months(4) if rng.random() < 0.7} for v in numbers}
    versions[5] = {}
    rows = spark.createDataFrame([(v, *k, x) for v, t in versions.items() for k, x in t.items()], f"version int, {OBS}")
    all_ = spark.createDataFrame([(v,) for v in numbers], "version int")
    whole = intervals.intervals(rows, all_)
    grown = intervals.intervals(rows.where("version = 1"))
    for v in numbers[1:]:
        grown = intervals.extended(grown, rows.where(F.col("version") == v).drop("version"), v)
    key = lambda r: tuple(str(x) for x in r)
    cols = ["material_id", "period", "value", "valid_from", "valid_to"]
    assert sorted(map(tuple, whole.select(cols).collect()), key=key) == sorted(map(tuple, grown.select(cols).collect()), key=key)
    for v in numbers:
        assert {(r.material_id, r.period): r.value for r in intervals.as_of(whole, v).collect()} == versions[v]
    got = {(r.material_id, r.period): r.change for r in intervals.changes(whole, 2, 9).collect()}
    want = {k: "inserted" if k not in versions[2] else "removed" if k not in versions[9] else "revised" for k in {*versions[2], *versions[9]} if versions[2].get(k, "no") != versions[9].get(k, "no")}
    assert got == want


# incremental signals


def test_refreshed_signals_equal_a_full_run(spark):
    rng = random.Random(4)
    old, new = {}, {}
    for s in range(60):
        for p in months(rng.choice([3, 14, 40, 60])):
            old[f"s{s:02d}", p] = rng.choice([0.0, 5.0]) if rng.random() < 0.05 else 50 + 50 * rng.random()
    for (s, p), v in old.items():
        fate = rng.random() if int(s[1:]) % 3 else 1
        if fate < 0.03:
            continue
        new[s, p] = v * 1.5 if fate < 0.06 else v
        if 0.06 <= fate < 0.09:
            new[s, p + "b"] = v / 2
    for p in months(20):
        new["new", p] = 50 + rng.random()
        old["gone", p] = 50 + rng.random()
    frame = lambda t: spark.createDataFrame([(*k, v) for k, v in t.items()], OBS)
    changes = spark.createDataFrame([(*k, "inserted" if k not in old else "removed" if k not in new else "revised") for k in {*old, *new} if old.get(k) != new.get(k)], "material_id string, period string, change string")
    for least in (13, 20):
        before, full = signals.history(frame(old), least), signals.history(frame(new), least)
        marked_only = frame(new).join(changes.select("material_id").distinct(), "material_id", "left_semi")
        got = incremental.refreshed(before, marked_only, changes, least)
        show = lambda df: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(full.columns)).collect()), key=str)
        assert show(got) == show(full)


def test_maintained_signals_follow_the_log(spark):
    obs, kept = new_log(spark), new_log(spark, order=("made_at",))
    rows = [(m, p, 50.0 + i + 3 * (m == "b")) for m in "abc" for i, p in enumerate(months(30))]
    obs.append(stamped(spark, rows, 1))
    assert incremental.maintain(obs, kept) == 1
    obs.append(stamped(spark, [("b", months(30)[20], 10.0)], 2))
    obs.append(stamped(spark, [("c", p, None) for p in months(30)[:18]], 3).withColumn("removed", F.lit(True)))
    assert incremental.maintain(obs, kept) == 3 == incremental.maintain(obs, kept)
    full = signals.history(obs.read().select("material_id", "period", "value"))
    cols = sorted(full.columns)
    assert kept.read().select(cols).exceptAll(full.select(cols)).isEmpty() and full.select(cols).exceptAll(kept.read().select(cols)).isEmpty()
    assert kept.read().where("material_id = 'c'").isEmpty() and kept.last().number == 2


def test_signal_table_of_no_rows(spark):
    none = spark.createDataFrame([], OBS)
    changes = spark.createDataFrame([], "material_id string, period string, change string")
    assert incremental.refreshed(signals.history(none), none, changes).isEmpty() and intervals.intervals(spark.createDataFrame([], f"version int, {OBS}")).isEmpty()
