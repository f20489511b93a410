"""Lists of several parts, registries that disagree, manifests and gates."""

import datetime as dt
import json
import os
import threading
import time

import pytest

from tidemark.sources import lists, manifest
from tidemark.sources.lists import ListError

KINDS = """<ReferenceValueSets><PartySubTypeValues><PartySubType ID="1" PartyTypeID="4">{vessel}</PartySubType><PartySubType ID="9">Aircraft</PartySubType></PartySubTypeValues>
<FeatureTypeValues><FeatureType ID="3">Vessel Flag</FeatureType><FeatureType ID="4">Vessel Type</FeatureType></FeatureTypeValues>
<IDRegDocTypeValues><IDRegDocType ID="1626">Vessel Registration Identification</IDRegDocType></IDRegDocTypeValues>
<EntryEventTypeValues><EntryEventType ID="1">Created</EntryEventType><EntryEventType ID="2">Amended</EntryEventType></EntryEventTypeValues></ReferenceValueSets>"""


def name(text, script="215"):
    return f'<DocumentedName><DocumentedNamePart><NamePartValue ScriptID="{script}">{text}</NamePartValue></DocumentedNamePart></DocumentedName>'


def profile(i, names, flag="Panama", kind="1", primary="true", of=None):
    feature = f'<Feature FeatureTypeID="4"><FeatureVersion><VersionDetail>Tanker</VersionDetail></FeatureVersion><IdentityReference IdentityID="id-{i}"/></Feature>'
    if flag:
        feature += f'<Feature FeatureTypeID="3"><FeatureVersion><VersionDetail DetailTypeID="1432">{flag}</VersionDetail></FeatureVersion><IdentityReference IdentityID="{of or f"id-{i}"}"/></Feature>'
    return f'<DistinctParty FixedRef="{i}"><Profile ID="p-{i}" PartySubTypeID="{kind}"><Identity ID="id-{i}" Primary="{primary}"><Alias Primary="false">{name("OTHER")}</Alias><Alias Primary="true">{names}</Alias></Identity>{feature}</Profile></DistinctParty>'


def paper(i, number, kind="1626"):
    return f'<IDRegDocument IDRegDocTypeID="{kind}" IdentityID="id-{i}"><IDRegistrationNo>{number}</IDRegistrationNo></IDRegDocument>'


def entry(i, *dates, program="CUBA", kind="1"):
    part = lambda tag, x: "" if x is None else f"<{tag}>{x}</{tag}>"
    events = "".join(f'<EntryEvent EntryEventTypeID="{kind}"><Date>{part("Year", y)}{part("Month", m)}{part("Day", d)}</Date></EntryEvent>' for y, m, d in dates)
    return f'<SanctionsEntry ProfileID="p-{i}">{events}<SanctionsMeasure><Comment></Comment></SanctionsMeasure><SanctionsMeasure><Comment>{program}</Comment></SanctionsMeasure></SanctionsEntry>'


def read(spark, tmp_path, profiles, entries, papers="", kinds=KINDS.format(vessel="Vessel")):
    path = tmp_path / f"list-{time.monotonic_ns()}.xml"
    path.write_text(f'<?xml version="1.0" encoding="utf-8"?><Sanctions>{kinds}<Locations/><IDRegDocuments>{papers}</IDRegDocuments><DistinctParties>{profiles}</DistinctParties><ProfileRelationships/><SanctionsEntries>{entries}</SanctionsEntries></Sanctions>')
    return {r.source_id: r for r in lists.read_advanced_list(spark, str(path)).collect()}


def test_vessels_of_an_advanced_list(spark, tmp_path):
    profiles = profile(1, name("MAR AZUL"), "Cuba") + profile(2, name("Кириллица", "220") + name("Baltic Leader")) + profile(3, name("Только", "220"), None) + profile(4, name("PLANE"), kind="9") + profile(5, name("ELSEWHERE"), of="id-1")
    papers = paper(1, "IMO 9187629") + paper(1, "IMO 1111111") + paper(2, "none") + paper(2, "1234567", kind="7") + paper(3, "9074729")
    entries = entry(1, (2010, 6, 16), (1995, 5, 23)) + entry(1, (2015, 3, 2), program="IRAN") + entry(2, (2005, 7, None)) + entry(2, (1990, 1, 1), kind="2") + entry(3, (1999, None, None)) + entry(4, (None, None, None)) + entry(5, (2001, 0, 0), program="") + entry(5, (2001, 6, 1), program="RUSSIA")
    got = read(spark, tmp_path, profiles, entries, papers)
    row = lambda i: tuple(got[f"p-{i}"])[2:]
    assert sorted(got) == ["p-1", "p-2", "p-3", "p-5"] and {r.source for r in got.values()} == {"ofac"}
    assert row(1) == ("MAR AZUL", "9187629", "Cuba", "CUBA", dt.date(1995, 5, 23), "day")
    assert row(2) == ("Baltic Leader", None, "Panama", "CUBA", dt.date(2005, 7, 1), "month")
    assert row(3) == ("Только", "9074729", None, "CUBA", dt.date(1999, 1, 1), "year")
    assert row(5) == ("ELSEWHERE", None, None, "UNKNOWN", dt.date(2001, 1, 1), "year")


def test_a_list_that_is_not_built_so_is_an_error(spark, tmp_path):
    fine, dated = profile(1, name("A")), entry(1, (2001, 6, 1))
    with pytest.raises(ListError, match="PartySubType"):
        read(spark, tmp_path, fine, dated, kinds=KINDS.format(vessel="Ship"))
    with pytest.raises(ListError, match="no designation"):
        read(spark, tmp_path, fine + profile(2, name("B")), dated)
    with pytest.raises(ListError, match="no designation"):
        read(spark, tmp_path, fine, entry(1, (2001, 6, 1), kind="2"))
    with pytest.raises(ListError, match="no year"):
        read(spark, tmp_path, fine, entry(1, ("soon", 6, 1)))
    with pytest.raises(ListError, match="primary name"):
        read(spark, tmp_path, profile(1, name("A"), primary="false"), dated)
    with pytest.raises(ListError, match="primary name"):
        read(spark, tmp_path, profile(1, name("  ")), dated)


def test_ships_of_a_schedule_list(spark, tmp_path):
    record = lambda imo, date, n, schedule="1", item="7": f"<record><Country-Pays>Russia</Country-Pays><EntityOrShip-EntiteOuNavire>{n}</EntityOrShip-EntiteOuNavire><ShipIMONumber-NumeroOMIDuNavire>{imo}</ShipIMONumber-NumeroOMIDuNavire><Schedule-Annexe>{schedule}</Schedule-Annexe><Item-NumeroDarticle>{item}</Item-NumeroDarticle><DateOfListing-DateDinscription>{date}</DateOfListing-DateDinscription></record>"
    path = tmp_path / "schedule.xml"
    path.write_text("<data-set>" + record("9074729", "2024-06-01", "LATER") + record("9074729", "2022-03-01", "FIRST", "2", "9") + record("", "2020-01-01", "A Person") + record("9187629", "", "UNDATED", "", "") + record("9187629", "not a date", "STILL UNDATED") + "</data-set>")
    got = {r.imo: tuple(r) for r in lists.read_schedule_list(spark, str(path)).collect()}
    assert got["9074729"] == ("ca", "ca-2-9", "FIRST", "9074729", None, "SEMA Schedule 2", dt.date(2022, 3, 1))
    assert got["9187629"] == ("ca", "ca-9187629", "UNDATED", "9187629", None, "UNKNOWN", None) and len(got) == 2


def page(*entries):
    value = lambda x: {"type": "literal", "value": x}
    bindings = [{k: value(v) for k, v in (("item", f"http://www.wikidata.org/entity/{item}"), ("imo", imo), ("p729", a), ("p571", b)) if v} for item, imo, a, b in entries]
    return json.dumps({"head": {"vars": []}, "results": {"bindings": bindings}}, indent=1)


def test_registry_pages_are_read_and_reconciled(spark, tmp_path):
    day = lambda y: f"{y}-05-01T00:00:00Z"
    (tmp_path / "0.json").write_text(page(("Q1", "9074729", day(2005), day(2003)), ("Q2", "9187629", None, day(1999)), ("Q3", "1234568", day(2000), None), ("Q4", "9074731", "http://www.wikidata.org/.well-known/genid/1", None)))
    (tmp_path / "1.json").write_text(page(("Q5", "9187629", None, day(2000)), ("Q6", "8814275", day(1990), None), ("Q7", "8814275", day(1995), None)))
    (tmp_path / "2.json").write_text(page())
    rows = lists.read_registry_pages(spark, str(tmp_path))
    raw = {r.item: r for r in rows.collect()}
    assert len(raw) == 7 and raw["Q1"].service_entry == dt.date(2005, 5, 1) and raw["Q4"].service_entry is None
    got = {r.imo: tuple(r)[1:] for r in lists.reconcile_build_years(rows).collect()}
    assert got["9074729"] == (1, "P729", True, 2005, False)
    assert got["9187629"] == (2, "P571", False, 1999, False)
    assert got["8814275"] == (2, "P729", False, None, True)
    assert "1234568" not in got and all(v == (1, None, False, None, False) for k, v in got.items() if k == "9074731")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"error": "rate limit"}')
    with pytest.raises(ListError, match="no results"):
        lists.read_registry_pages(spark, str(tmp_path / "bad"))
    (tmp_path / "bad" / "x.json").write_text(page(("Q9", None, day(2000), None)))
    with pytest.raises(ListError, match="no number"):
        lists.read_registry_pages(spark, str(tmp_path / "bad"))


def test_match_summary_and_numbers_that_cannot_be_right(spark):
    ids = spark.createDataFrame([(1, "9074729"), (2, "9074729"), (2, "9074729"), (3, "9187629"), (4, "123"), (5, None)], "mmsi long, imo string")
    sanctions = spark.createDataFrame([("a", "9074729"), ("b", "9074729"), ("c", "8814275"), ("d", "9074728"), ("e", None)], "source_id string, imo string")
    row, wrong = lists.match_summary(ids, sanctions)
    assert tuple(row.first()) == (3, 2, 1, 2) and [r.source_id for r in wrong.collect()] == ["d"]
    assert tuple(lists.match_summary(ids.limit(0), sanctions)[0].first()) == (3, 0, 0, 0)


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/deep/manifest.json", []

    def writer(k):
        try:
            for i in range(6):
                manifest.record(spark, path, f"2024-07-{6 * k + i + 1:02d}", downloaded_at=k)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(manifest.load(spark, path)) == 30
    assert [f for f in os.listdir(tmp_path / "deep") if not f.endswith(".crc")] == ["manifest.json"]


def test_entries_grow_and_stale_locks_break(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    assert manifest.load(spark, path) == {} and manifest.day_state(None) == "absent"
    manifest.record(spark, path, "2024-07-01", downloaded_at="x", rows=5)
    assert manifest.day_state(manifest.load(spark, path)["2024-07-01"]) == "raw_only"
    lock = tmp_path / "manifest.json.lock"
    lock.write_text("someone")
    os.utime(lock, (time.time() - 65, time.time() - 65))
    entries = manifest.record(spark, path, "2024-07-01", cleaned_at="y")
    assert entries["2024-07-01"] == {"downloaded_at": "x", "rows": 5, "cleaned_at": "y"} and manifest.day_state(entries["2024-07-01"]) == "clean"
    assert manifest.day_state(manifest.record(spark, path, "2024-07-01", clean_discarded_at="z")["2024-07-01"]) == "reduced"
    assert not lock.exists()
    with manifest.locked(spark, path):
        lock.write_text("taken by another, as this one was slow")
    assert lock.exists()


def test_days_come_from_folders_first_and_the_legacy_table_else(spark, tmp_path):
    rows = [(d, f"day {d}", "own") for d in (3, 4, 6)]
    df = spark.createDataFrame([(dt.date(2024, 6, d), t, k) for d, t, k in rows], "date date, t string, kind string")
    df.write.partitionBy("date").parquet(f"{tmp_path}/days")
    spark.createDataFrame([(dt.date(2024, 6, d), f"old {d}") for d in (1, 2, 3)], "date date, t string").write.parquet(f"{tmp_path}/legacy")
    got, missing = manifest.read_listed_days(spark, f"{tmp_path}/days", "2024-06-01", "2024-06-06", f"{tmp_path}/legacy")
    assert sorted((r.date.day, r.t, r.kind) for r in got.collect()) == [(1, "old 1", None), (2, "old 2", None), (3, "day 3", "own"), (4, "day 4", "own"), (6, "day 6", "own")]
    assert missing == ["2024-06-05"]
    assert manifest.read_listed_days(spark, f"{tmp_path}/none", "2024-06-01", "2024-06-01") == (None, ["2024-06-01"])


def test_gates_of_retention_and_rates(spark):
    day = lambda d, n: [(f"2024-06-0{d}",)] * n
    raw, clean = (spark.createDataFrame(x, "date string") for x in (day(1, 10) + day(2, 10) + day(3, 5), day(1, 4) + day(2, 2) + day(4, 1)))
    got = {r.date[-1]: (r.n_before, r.n_after, r.passes) for r in manifest.retention_gate(raw, clean).collect()}
    assert got == {"1": (10, 4, True), "2": (10, 2, False), "3": (5, 0, False), "4": (0, 1, False)}
    events = spark.createDataFrame([("a",)] * 30 + [("b",)] * 2, "kind string")
    got = {r.kind: (r.observed, r.passes) for r in manifest.rate_gate(events, "kind", {"a": 1.0, "b": 3.0, "c": 0.01, "d": 1.0, "e": 0.0}, 10).collect()}
    assert got == {"a": (30, True), "b": (2, False), "c": (0, True), "d": (0, False), "e": (0, True)}


def test_lists_in_csv_with_line_breaks_and_semicolons(spark, tmp_path):
    from tidemark.sources.readers import read_uk_list

    uk = tmp_path / "uk.csv"
    uk.write_text('Report Date: 01-Jun-2024\nUnique ID,Name 6,Name type,Designation Type,IMO number,Current believed flag of ship,Date Designated,Other Information\n1,TORN,Alias,Ship,9074729,Panama,05/06/2023,"a note\nof two lines, with a ""quote"""\n1,WHOLE,Primary name,Ship,9074729,,01/02/2022,\n2,PERSON,Primary name,Individual,,,01/01/2020,"x\ny"\n')
    got = [tuple(r) for r in read_uk_list(spark, str(uk)).select("source_id", "vessel_name", "imo", "flag", "designation_date").collect()]
    assert got == [("1", "WHOLE", "9074729", "Panama", dt.date(2022, 2, 1))]
    eu = tmp_path / "eu.csv"
    eu.write_text("﻿Vessel name;IMO number ;Subject to;Date of application\nLATER;IMO 9074729;Article 3s of 833/2014;01.07.2024\nFIRST;9074729;Article 3s of 833/2014;24.06.2024\nOTHER;9187629;DPRK;01.01.2018\nUNDATED;8814275;Article 3s;soon\n")
    got = {r.imo: tuple(r)[1:] for r in lists.read_eu_vessels(spark, str(eu)).collect()}
    assert got == {"9074729": ("dma-eu-9074729", "FIRST", "9074729", None, "Article 3s of 833/2014", dt.date(2024, 6, 24)), "8814275": ("dma-eu-8814275", "UNDATED", "8814275", None, "Article 3s", None)}
    eu.write_text("a;b\n1;2\n")
    with pytest.raises(ListError, match="lacks"):
        lists.read_eu_vessels(spark, str(eu))
