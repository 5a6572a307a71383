import hashlib
import json

import pytest
from pyspark.sql import functions as F

from confluo.operators import control, fusion, pairs, ranking, resolution, schedule, sets
from confluo.sources import calendar, html, records


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(
    ("field", "found", "state", "value", "approval"),
    [
        ("prices", [("[9900]", "published"), ("[9900]", "published")], "published", "[9900]", "pending_review"), ("startTime", [("18:00", "published"), ("19:00", "published")], "conflicting_sources", None, "conflict"),
        ("purchaseUrls", [('["B"]', "published"), ('["A","B"]', "published")], "published", '["A","B"]', "pending_review"), ("prices", [("[10000,900]", "published"), ("[900,8000]", "published"), ("[1]", "not_checked")], "published", "[900,8000,10000]", "pending_review"), ("title", [(None, "not_announced"), (None, "not_checked")], "not_checked", None, "pending_review"), ("title", [(None, "parser_failed")], "parser_failed", None, "pending_review"),
    ],
)
def test_merge_evidence(spark, field, found, state, value, approval):
    items = lambda v: [json.dumps(x) for x in json.loads(v)] if v and v[0] == "[" else None
    df = spark.createDataFrame([("c", field, v, items(v), s, f"h{i}", 0.5 + i / 10) for i, (v, s) in enumerate(found)], "id string, field string, value_json string, items array<string>, availability_status string, evidence_hash string, confidence double")
    (r,) = fusion.merge_evidence(df, ["id"]).collect()
    assert (r["availability_status"], r["value_json"], r["approval_state"]) == (state, value, approval)
    assert (r["approval_hash"] is None) == (approval == "conflict")
    if state == "published" and value != found[0][0]:  # a union: its text, then the sorted hashes of what was published
        hashes = sorted(f"h{i}" for i, (_, x) in enumerate(found) if x == "published")
        assert r["approval_hash"] == hashlib.sha256("|".join([value, *hashes]).encode()).hexdigest()
    assert fusion.merge_evidence(df.repartition(3).orderBy(F.rand(1)), ["id"]).collect() == [r]


def test_approvals(spark):
    merged = spark.createDataFrame([("a", "title", "h1", "published"), ("a", "date", "h2", "published"), ("b", "title", "h3", "published"), ("b", "date", None, "conflicting_sources")], "id string, field string, approval_hash string, availability_status string")
    reviews = spark.createDataFrame([("a", "title", "h1"), ("a", "date", "h2"), ("b", "title", "old"), ("b", "date", "x")], "id string, field string, approved_hash string")
    done = fusion.apply_approvals(merged, reviews, ["id"])
    assert rows(done, "id", "field", "approval_state") == [("a", "date", "approved"), ("a", "title", "approved"), ("b", "date", "conflict"), ("b", "title", "changed")]
    assert rows(fusion.gate(done, ["id"], ("title", "date")), "id", "approved_fields", "review_state") == [("a", 2, "approved"), ("b", 0, "candidate")]


def test_fuse_and_slots(spark):
    df = spark.createDataFrame([(0, "k", "venue", "p"), (1, "k", "artist", "q"), (2, "k", "artist", "p"), (3, "l", "api", None)], "seq int, key string, kind string, url string")
    out = fusion.fuse(df, ["key"], F.when(F.col("kind") == "artist", 2).otherwise(1), "seq", {"url": "urls"}, F.col("kind") != "api")
    assert [(r["members"], r["preferred"]["seq"], r["urls"], r["evidence_level"]) for r in out.orderBy("key").collect()] == [(3, 1, ["p", "q"], "corroborated"), (1, 3, [], "aggregator_only")]
    slots = spark.createDataFrame([("s", "v"), ("s", None), ("t", "v"), ("t", "v")], "slot string, venue string")
    assert rows(fusion.slot_conflicts(slots, ["slot"], F.col("venue")), "slot", "identities", "members") == [("s", 2, 2)]


def test_resolve(spark):
    variants = spark.createDataFrame([("v1", "zepptokyo"), ("v1", "zepp"), ("v2", "zepptokyobayside"), ("v3", "budokan")], "entity_id string, variant string")
    aliases = spark.createDataFrame([("thehall", "v3"), ("gone", "v9")], "name string, alias_id string")
    cases = [(1, "x", "v2"), (2, "thehall", None), (3, "zepp", None), (4, "atzepptokyohall", None), (5, "budo", None), (6, "nowhere", None), (7, "gone", None), (8, "zepptokyobaysidehall", None), (9, "budok", "bad")]
    df = spark.createDataFrame(cases, "k int, name string, hint string")
    assert rows(resolution.resolve(df, "k", "name", "hint", variants, aliases), "k", "entity_id") == [(1, "v2"), (2, "v3"), (3, "v1"), (4, "v1"), (5, "v3"), (6, None), (7, None), (8, "v2"), (9, "v3")]
    kana = spark.createDataFrame([("e", "すーぱー")], "entity_id string, variant string")
    assert rows(resolution.folded(spark.createDataFrame([(1, "スーパー"), (2, "すーぱー")], "k int, name string"), "name", kana), "k", "entity_id") == [(1, "e")]


def test_match_observations(spark):
    kind = "date string, venue_name string, start_time string, title string, artist_names array<string>"
    events = spark.createDataFrame([("e1", "2026-01-01", "hall", "13:00", "day", ["abc"]), ("e2", "2026-01-01", "hall", "18:00", "night", ["abc"]), ("e3", "2026-01-02", "arena", "18:00", "tour", ["xyz"])], f"id string, {kind}")
    obs = spark.createDataFrame([(1, "2026-01-02", "arena", None, None, None), (2, "2026-01-01", "hall", "18:00", "", ["abc"]), (3, "2026-01-01", "hall", None, "night", ["abc"]), (4, "2026-05-05", "nowhere", None, "q", ["q"]), (5, "2026-09-09", "arena", "18:00", "tour", ["xyz"])], f"obs_id int, {kind}")
    assert rows(resolution.match_observations(obs, events), "obs_id", "event_id", "level", "reason") == [(1, "e3", "confirmed", "date_venue"), (2, "e2", "confirmed", "date_venue_time"), (3, "e2", "probable", "ambiguous_same_day_venue"), (4, None, "unmatched", "insufficient_evidence"), (5, "e3", "probable", "light_score")]


def test_ranking_and_sets(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("a", 3, 2), ("b", 5, 3)], "k string, at int, seq int")
    assert rows(ranking.latest(df, ["k"], "at", "seq"), "k", "seq") == [("a", 1), ("b", 3)]
    assert rows(ranking.keep_first(df, ["k"], "seq"), "k", "seq") == [("a", 0), ("b", 3)]
    assert rows(ranking.batch(df, [F.col("seq")], 2), "seq", "selected") == [(0, True), (1, True), (2, False), (3, False)]
    assert rows(sets.difference(df, df, ["k"]), "k") == [] and rows(sets.changed(df, df, "k", "at").filter("k = 'b'"), "k") == []
    new = spark.createDataFrame([("b", 9, 9), ("c", 9, 9)], df.schema)
    assert rows(sets.upsert(df.filter("seq > 1"), new, ["k"], spark.createDataFrame([("a",)], "k string")), "k", "at") == [("b", 9), ("c", 9)]
    assert rows(sets.layered([df, new], ["k"], "seq"), "k", "seq", "layer") == [("a", 2, 0), ("b", 9, 1), ("c", 9, 1)]


def test_band_join_is_whole(spark):
    a = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.date_add(F.lit("2024-02-20").cast("date"), F.col("id").cast("int")).alias("x"))
    b = a.select("k", F.col("i").alias("j"), F.col("x").alias("y"))
    want = sorted((i, j) for i in range(60) for j in range(60) if abs(i - j) <= 3)
    assert sorted(tuple(r) for r in pairs.band_join(a, b, "k", "x", "y", 3).select("i", "j").collect()) == want


def test_trip_conflicts(spark):
    kind = "trip_id int, event_id string, pos int, date string, open_time string, start_time string, end_override string, place string, buffer_minutes int"
    events = spark.createDataFrame([(1, "a", 0, "2026-01-01", "12:00", "13:00", None, "tokyo", 90), (1, "b", 1, "2026-01-01", "15:00", "16:00", None, "osaka", 90), (1, "c", 2, "2026-01-02", "12:00", "13:00", None, "x", 90), (1, "d", 3, "2026-01-02", "16:00", "17:00", "01:00", "x", 90)], kind)
    legs = spark.createDataFrame([(1, "leg")], "trip_id int, leg_id string").withColumn("depart_at", F.to_timestamp(F.lit("2026-01-02T23:00:00+09:00")))
    assert rows(schedule.conflicts(events, legs), "kind", "event_id", "other") == [("buffer", "c", "d"), ("cross_prefecture", "a", "b"), ("overlap", "a", "b"), ("return_before_end", "d", "leg")]


def test_timeline_and_actions(spark):
    e = spark.createDataFrame([(1, "2026-01-01", "17:00", "18:00", "20:30")], "trip_id int, date string, open_time string, start_time string, end_time string")
    own = spark.createDataFrame([(1, "2026-01-01", None, "note"), (1, "2026-01-01", "09:00", "train")], "trip_id int, day string, at string, label string")
    assert [r["label"] for r in schedule.timeline(e, own).collect()] == ["train", "doors", "start", "end", "note"]
    offers = spark.createDataFrame([("e", "1", None, "open", None, "2026-01-05", None, None), ("e", "2", "won", "closed", None, None, None, "2026-01-03"), ("f", "3", None, "closed", None, None, None, None)], "event_id string, id string, application string, sale_status string, start_at string, end_at string, result_at string, payment_deadline string")
    assert rows(schedule.next_action(offers, F.lit("2026-01-04")), "event_id", "label", "offer_id", "overdue") == [("e", "pay", "2", True)]


def test_select_jobs(spark):
    jobs = spark.createDataFrame([(0, "u0", "e0", "deferred", "2026-01-01"), (1, "u1", "e1", "deferred", "2026-03-01"), (2, "u2", "e2", "pending", None), (3, "u3", "e3", "pending", None), (4, "u4", "e4", "done", None)], "seq int, url string, event_id string, status string, next_check string")
    pick = lambda *a: rows(control.select_jobs(jobs, F.lit("2026-02-01"), *a), "url", "reasons", "selected")
    assert pick([], [], 0, 10) == [("u0", "due", True)]
    assert pick(["u1"], ["e3", "e4"], 0, 2) == [("u0", "due", True), ("u1", "url", True), ("u3", "event", False)]
    assert pick([], [], 1, 10) == [("u0", "due", True), ("u2", "pending limit", True)] and pick([], ["e3"], 1, 10) == [("u0", "due", True), ("u3", "event", True)]
    with pytest.raises(ValueError):
        pick([], [], 11, 10)


def test_merge_queue(spark):
    out = control.merge_queue(spark.createDataFrame([("a", "t"), ("b", "t")], "url string, role string"), spark.createDataFrame([("a", "done", 2), ("z", "done", 1)], "url string, status string, attempts int"))
    assert rows(out, "url", "status", "attempts") == [("a", "done", 2), ("b", "pending", 0)]


def test_calendar(spark):
    long = "あ" * 60 + ";,\n"
    df = spark.createDataFrame([(1, long)], "id int, s string").withColumn("t", F.lit("2026-08-12 09:00:00").cast("timestamp"))
    (r,) = calendar.events(df, F.col("id").cast("string"), F.col("t"), F.col("t"), F.col("s"), F.lit("x")).collect()
    assert "DTSTART:20260812T090000Z" in r["vevent"] and all(len(x.encode()) <= 75 for x in r["vevent"].split("\r\n"))
    assert "SUMMARY:" + "あ" * 60 + "\\;\\,\\n" in r["vevent"].replace("\r\n ", "")


def test_html(spark):
    page = """<div class="card"><a href="/x">One</a><br><a class="k" href="/y">Two <b>2</b></a></div><table><tr><th>Price</th><td>¥9,900</td></tr></table>
<script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "Live", "startDate": "2026-01-02T18:00", "location": {"name": "Hall"}}, {"@type": "Place"}]}</script><script type="application/ld+json">{broken</script>
<script id="__NEXT_DATA__">{"a": [{"title": "T", "date": "2026-01-01", "venue": {"name": "V"}}, {"title": "T", "date": "2026-01-01", "location": {"name": "V"}}, {"title": "text alone", "date": "2026-01-01", "venue": "V"}]}</script>"""
    html.register(spark)
    spark.createDataFrame([(page,)], "html string").createOrReplaceTempView("raw_pages")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT t.href, t.label FROM raw_pages, LATERAL html_elements(html, 'a') t ORDER BY pos") == [("/x", "One"), ("/y", "Two 2")]
    assert sql("SELECT t.* FROM raw_pages, LATERAL html_table(html) t") == [("Price", "¥9,900")]
    found = sql("SELECT t.title, t.date, t.venue_name, t.error IS NULL FROM raw_pages, LATERAL json_ld_events(html) t")
    assert found == [("Live", "2026-01-02", "Hall", True), (None, None, None, False)]
    assert sql("SELECT t.title, t.date, t.venue_name FROM raw_pages, LATERAL embedded_events(html) t") == [("T", "2026-01-01", "V")]


def test_records(spark, tmp_path):
    assert records.read_json(spark, f"file://{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert records.read_json(spark, f"file://{tmp_path}/x.json", "a int").count() == 2
    api = '{"_embedded": {"events": [{"id": "1", "name": "N", "dates": {"start": {"localDate": "2026-01-01", "localTime": "18:30:00"}}, "priceRanges": [{"currency": "JPY", "min": 9000.0, "max": 12000.0}], "_embedded": {"venues": [{"name": "V"}]}}, {"id": "2", "name": "M"}]}}'
    (r,) = records.api_events(spark.createDataFrame([(api,)], "content string")).collect()
    assert (r["start_time"], r["prices_jpy"], r["venue_name"]) == ("18:30", [9000, 12000], "V")
    shows = spark.createDataFrame([(["12:00"], ["13:00", "18:00"])], "opens array<string>, starts array<string>")
    assert rows(records.arena_shows(shows), "open_time", "start_time") == [("12:00", "13:00"), ("12:00", "18:00")]
    raw = spark.createDataFrame([("s", "b", "x"), ("s", "b", "y")], "source_id string, batch_id string, content string")
    records.append_evidence(raw, f"file://{tmp_path}/evidence")
    assert records.broken_evidence(spark.read.parquet(f"file://{tmp_path}/evidence")).count() == 0
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string")
    assert rows(records.stale_exports(old, new, "k"), "k") == [(2,), (3,)]
    back, lost = records.from_backup(records.to_backup(new, 5, ["k", "v"]), "k int, v string", old, "k")
    assert rows(back, "k") == [(1,), (2,)] and rows(lost, "k") == [(3,)]
    wall = lambda h, u: spark.range(1).select(records.access_restricted(F.lit(h), F.lit(u))).first()[0]
    assert wall("<p>Human verification</p>", "https://x.jp/a") and wall("ok", "https://x.jp/login") and not wall("<script src='recaptcha.js'></script>ok", "https://x.jp/a") and wall("<input type='password'> Login", "https://x.jp/")


def test_streaming(spark, tmp_path):
    from confluo.streaming import state

    src, schema = f"file://{tmp_path}/in", "k string, at timestamp, seq int"
    make = lambda r: spark.createDataFrame(r, "k string, at string, seq int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    folder = f"file://{tmp_path}/table"
    for part in ([("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], [("a", "2024-01-03", 3), ("b", "2024-01-01", 4)]):
        make(part).write.mode("append").parquet(src)
        state.upsert_batches(spark.readStream.schema(schema).parquet(src), folder, ["k"], "at", "seq", f"file://{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/v1"), "k", "seq") == [("a", 3), ("b", 2)]
    q = state.append_once(spark.readStream.schema(schema).parquet(src), ["k"], "at").writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = state.windowed_counts(spark.readStream.schema(schema).parquet(src), "at", ["k"], "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 4


def test_gates_and_seeds(spark):
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(control.planned_ids(spark, ["b", "a", "b"], known, "id"), "id") == [("a",), ("b",)]
    for bad in ([], ["zz"], [str(i) for i in range(11)]):
        with pytest.raises(ValueError):
            control.planned_ids(spark, bad, known, "id")
    links = spark.createDataFrame([("e1", "https://X.jp/a/?utm_source=q", "official", False), ("e2", "https://x.jp/a", "ticket_detail", None), ("e3", "https://x.jp/b", "official", True), ("e4", "none", "official", False)], "event_id string, url string, role string, checked boolean")
    assert rows(control.seed_jobs(links), "url", "role", "event_ids") == [("https://x.jp/a", "ticket_detail", ["e1", "e2"])]
    offers = spark.createDataFrame([("event_detail", "x"), ("search", "x")], "url_kind string, fact string")
    assert rows(control.without_facts(offers, ["fact"]), "url_kind", "fact") == [("event_detail", "x"), ("search", None)]
    none = spark.createDataFrame([], "path string, rule string")
    assert control.gated(offers, none).count() == 2
    with pytest.raises(ValueError):
        control.gated(offers, spark.createDataFrame([("p", "r")], none.schema))


def test_groups_and_collation(spark):
    from confluo.operators import reports

    df = spark.createDataFrame([(1, "2026-01-01 00:00:00", "b"), (1, "bad", "a"), (1, None, "unknown"), (2, None, "")], "k int, at string, v string")
    out = df.groupBy("k").agg(reports.latest_of(F.col("at"), F.lit("2020-01-01").cast("timestamp")).alias("at"), reports.known_joined(F.col("v")).alias("v")).orderBy("k").collect()
    assert [(str(r["at"])[:10], r["v"]) for r in out] == [("2026-01-01", "a, b"), ("2020-01-01", "")]
    kana = spark.createDataFrame([("い",), ("ア",), ("う",)], "s string")
    assert [r["s"] for r in kana.orderBy(ranking.japanese("s")).collect()] == ["ア", "い", "う"]


def test_deadlines(spark):
    from confluo.functions import clock

    df = spark.createDataFrame([("2026-02-30T10:00",), ("2026-02-28T24:00",), ("2026-02-28T10:00",), (None,)], "c string")
    assert [r[0] for r in df.select(clock.valid_local(F.col("c"))).collect()] == [False, False, True, False]
    assert [str(r[0]) for r in df.select(clock.deadline_instant(F.col("c")).cast("string")).collect()] == ["None", "None", "2026-02-28 01:00:00", "None"]
