"""The composed plans on small fixtures."""

from pyspark.sql import functions as F

from ledgerline.plans import assembly, bundles, harvest


def test_harvest(spark):
    albums = spark.createDataFrame([(1, True, 0, 2), (2, False, 0, 1)], "album_id long, monitored boolean, have long, total long")
    tracks = spark.createDataFrame([
        (1, 1, "Sugar", "Billie", "A", 100_000, False, True), (2, 1, "Deep River", "Odetta", "A", 90_000, True, True), (3, 2, "Blue", "X", "B", 1, False, True)],
        "ordinal long, album_id long, title string, artist string, album string, duration_ms long, has_file boolean, track_monitored boolean")
    src = spark.createDataFrame([(10, "f", "s1", "Sugar", "Billie", 101_000), (11, "f", "s1", "Sugar!", "Billie", 100_500), (12, "f", "s1", "Deep River", "Odetta", 90_000), (13, "g", "s2", "Sugar", "Billie", 100_000)],
                                "ordinal long, key string, signature string, title string, artist string, duration_ms long")
    ledger = spark.createDataFrame([("g", "s2")], "key string, signature string")
    got = {r["ordinal"]: r["outcome"] for r in harvest.harvest(src, tracks, albums, ledger=ledger).collect()}
    assert got == {10: "duplicate", 11: "matched", 12: "rejected"}


def test_bundles(spark):
    files = spark.createDataFrame([
        ("h", 0, "b", "Weezer/1994 - Blue/01.flac", 5, 1), ("h", 1, "b", "Weezer/1994 - Blue/cover.jpg", 5, 1),
        ("h", 2, "b", "Weezer/2001 - Green/01.flac", 5, 1), ("h", 3, "b", "Weezer/clip.mkv", 5, 0)],
        "hash string, idx int, bundle string, path string, size long, priority int")
    albums = spark.createDataFrame([(1, 1, "Weezer", "Blue", 1, 1, 1, 1, "1994"), (2, 2, "Weezer", "Green", 0, 1, 0, 1, "2001")],
                                   "ordinal long, album_id long, artist string, title string, have long, total long, tracks_have long, tracks_total long, release_date string")
    rel = spark.createDataFrame([(1, 1)], "album_id long, track_count int")
    none = spark.createDataFrame([], "path string")
    got = {r["idx"]: (r["drop"], r["apply"]) for r in bundles.narrow_bundles(files, albums, rel, none).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (False, False), 3: (True, False)}


def test_assembly(spark):
    tracks = spark.createDataFrame([(1, "t1", "sugar", "billie", False, False), (1, "t2", "river", "billie", False, True), (2, "t3", "sugar", "nobody", False, False)],
                                   "album_id long, track_id string, title_key string, want_artist string, various boolean, has_file boolean")
    src = spark.createDataFrame([(1, "p", ["sugar"], ["billie"], [])], "ordinal long, path string, titles array<string>, strong array<string>, weak array<string>")
    rows, plans = assembly.plan_albums(tracks, src, now=5)
    assert {r["track_id"]: r["state"] for r in rows.collect()} == {"t1": "matched", "t2": "present"}
    assert plans.first()["pct"] == 100.0
    carried = spark.createDataFrame([("k", "Best Of Blues", "a", "", 1), ("k", "Best Of Blues", "b", "", 2)], "release_key string, title string, track string, date string, ordinal long")
    assert assembly.hunt_queries(carried, "Billie").first()["term"] == "Billie Best Of Blues"
    found = spark.createDataFrame([("k", "Billie Best Blues FLAC", "Best Of Blues", "Billie", 1, 5, 0, True), ("k", "Other", "Best Of Blues", "Billie", 2, 9, 0, True)],
                                  "release_key string, found_title string, title string, artist string, ordinal long, seeders int, leechers int, lossless boolean")
    assert [r["ordinal"] for r in assembly.rank_found(found).collect()] == [1]


def test_harvest_judges_once(spark):
    albums = spark.createDataFrame([(1, True, 0, 2)], "album_id long, monitored boolean, have long, total long")
    tracks = spark.createDataFrame([(1, 1, "Sugar", "Billie", "A", 100_000, False, True)],
                                   "ordinal long, album_id long, title string, artist string, album string, duration_ms long, has_file boolean, track_monitored boolean")
    src = spark.createDataFrame([(10, "f", "s1", "Sugar", "Billie", 101_000)], "ordinal long, key string, signature string, title string, artist string, duration_ms long")
    plan = harvest.harvest(src, tracks, albums)._jdf.queryExecution().optimizedPlan().toString()
    assert "signature" not in plan and "monitored" not in plan  # matched and rejected rows both come from rows that were written once
