"""Small cases of scores, sides, identity, pages, tables and models."""

import math

import pytest
from pyspark.sql import functions as F

from downfield.functions.context import half_seconds, loaded_half_seconds
from downfield.functions.names import initial_last, roster_key
from downfield.functions.parse import filled_distance
from downfield.operators import curves as C
from downfield.operators import drives as D
from downfield.operators import games as G
from downfield.operators import identity as I
from downfield.operators import leaders as L
from downfield.operators import models as M
from downfield.operators import stats as S
from downfield.sources import pages as P
from downfield.sources import refresh as R
from downfield.sources import tables as T

PLAY = "game_id long, play_index long, play_type string, possession_team_id long, touchdown boolean, pat_good boolean, fg_good boolean, safety boolean"


def test_scores_before_plays(spark):
    rows = [(1, 0, "pass", 1, True, True, None, False), (1, 1, "kickoff", 1, False, None, None, False), (1, 2, "field_goal", 2, False, None, True, False), (1, 3, "sack", 2, False, None, None, True), (1, 4, "rush", None, False, None, None, False), (2, 0, "rush", 1, True, None, None, False)]
    got = [(r.score_home, r.score_away) for r in G.with_scores(spark.createDataFrame(rows, PLAY)).orderBy("game_id", "play_index").collect()]
    assert got == [(0, 0), (0, 7), (0, 7), (3, 7), (3, 9), (None, None)]


def test_scores_that_exist_stay(spark):
    rows = [(1, 0, "pass", 1, True, True, None, False, 5, 6), (1, 1, "rush", 2, False, None, None, False, None, None)]
    got = G.with_scores(spark.createDataFrame(rows, PLAY + ", score_home int, score_away int")).orderBy("play_index").collect()
    assert [(r.score_home, r.score_away) for r in got] == [(5, 6), (None, None)]


@pytest.mark.parametrize(
    ("plays", "want"),
    [
        ([(1, "kickoff", 0, None), (1, "rush", 25, "H"), (2, "kickoff", 0, None), (2, "pass", 25, "A")], (1, 2)),
        ([(1, "kickoff", 0, None), (1, "rush", 25, "A"), (2, "rush", 40, "H")], (2, 1)),
        ([(1, "kickoff", 0, None), (1, "rush", 30, "H"), (2, "rush", 60, "A")], (1, 2)),
        ([(1, "rush", 25, "H"), (2, "rush", 25, "H")], (2, 1)),
        ([(1, "kickoff", 0, None), (1, "rush", 25, "H"), (1, "kickoff", 0, None), (1, "rush", 25, "A"), (2, "kickoff", 0, None), (2, "rush", 25, "H")], (2, 1)),
    ],
)
def test_kickoff_sides(spark, plays, want):
    rows = [(7, i, k, y, t, p, "H", "A") for i, (p, k, y, t) in enumerate(plays)]
    df = spark.createDataFrame(rows, "game_id long, play_index long, play_type string, yard_line int, yard_line_team string, possession_team_id long, home_team string, away_team string")
    assert [(r.home_id, r.away_id) for r in G.kickoff_sides(df).collect()] == [want]


def _keyed(spark, rows, **more):
    df = spark.createDataFrame(rows, "season int, game_id long, play_index long, role string, name string, team string")
    return I.with_player_key(df, **more)


def test_identity(spark):
    rows = [(25, 1, 0, "passer", "Sorel, J.", "A"), (26, 2, 0, "passer", "John Sorel", "A"), (26, 2, 1, "rusher", " sorel, j ", "B"), (27, 3, 0, "rusher", "Jones, K.", None), (27, 3, 1, "receiver", "Jean Claude Tarn", "A"), (27, 3, 2, "receiver", "Tarn, J.", "A"), (27, 3, 3, "receiver", "JJ", None)]
    keyed = _keyed(spark, rows)
    assert {r.name.strip(): r.player_key for r in keyed.collect()} == {"Sorel, J.": "sorel, j", "John Sorel": "sorel, j", "sorel, j": "sorel, j", "Jones, K.": "jones, k", "Jean Claude Tarn": "tarn, j", "Tarn, J.": "tarn, j", "JJ": "jj"}
    people = {r.player_key: r for r in I.players(keyed).collect()}
    assert [people[k].player_id for k in ("sorel, j", "jones, k", "tarn, j", "jj")] == [1, 2, 3, 4]
    assert (people["sorel, j"].first_season, people["sorel, j"].last_season, people["sorel, j"].mentions) == (25, 26, 3)
    known = spark.createDataFrame([("jj", 9), ("gone", 12)], "player_key string, player_id long")
    again = {r.player_key: r.player_id for r in I.players(keyed, known).collect()}
    assert again == {"jj": 9, "sorel, j": 13, "jones, k": 14, "tarn, j": 15}


def test_identity_overrides_apart_and_ambiguous(spark):
    rows = [(25, 1, 0, "passer", "Sorel, J.", "A"), (25, 1, 1, "passer", "Sorel, J.", "B"), (25, 1, 2, "passer", "John Sorel", "C"), (25, 1, 3, "passer", "Sorell, J.", "A")]
    over = spark.createDataFrame([("Sorell, J.", "Sorel, J.")], "name string, canonical string")
    apart = spark.createDataFrame([("John Sorel",)], "name string")
    roster = spark.createDataFrame([("Sorel, J.", 1), ("Sorel, J.", 2)], "name string, index_player_id long")
    got = sorted((r.name, r.team, r.player_key) for r in _keyed(spark, rows, overrides=over, apart=apart, roster=roster).collect())
    assert got == [("John Sorel", "C", "john sorel"), ("Sorel, J.", "A", "sorel, j|A"), ("Sorel, J.", "B", "sorel, j|B"), ("Sorell, J.", "A", "sorel, j|A")]


def test_later_mentions_keep_ids(spark, tmp_path):
    """Stored names are not resolved again, new ones find stored 'Last, F.' names; ids stay, seasons widen, only the partitions hit change."""
    old = [(25, 1, 0, "passer", "Sorel, J.", "A"), (25, 1, 1, "rusher", "Max Odd", "B"), (26, 2, 0, "passer", "Jones, K.", "A")]
    new = [(28, 9, 0, "passer", "John Sorel", "A"), (28, 9, 1, "rusher", "Max Odd", "B"), (29, 9, 2, "rusher", "Odd, M.", "B"), (29, 9, 3, "receiver", "Fresh, F.", None), (24, 9, 4, "passer", "Jones, K.", "A")]
    path, first = f"file://{tmp_path}/people", _keyed(spark, old)
    R.write_dimension(I.players(first), path, "player_key")
    schema = "season long, game_id long, play_index long, role string, name string, team string"
    later = I.extend_keys(spark.createDataFrame(new, schema), I.name_keys(first))
    assert {r.name: r.player_key for r in later.collect()} == {"John Sorel": "sorel, j", "Max Odd": "max odd", "Odd, M.": "odd, m", "Fresh, F.": "fresh, f", "Jones, K.": "jones, k"}
    hit = I.extend_players(spark, path, later)
    got = {r.player_key: (r.player_id, r.name, r.first_season, r.last_season, r.mentions) for r in R.read_dimension(spark, path).collect()}
    assert got == {"sorel, j": (1, "Sorel, J.", 25, 28, 2), "max odd": (2, "Max Odd", 25, 28, 2), "jones, k": (3, "Jones, K.", 24, 26, 2), "odd, m": (4, "Odd, M.", 29, 29, 1), "fresh, f": (5, "Fresh, F.", 29, 29, 1)}
    assert len(hit) <= 5


def test_shared_names_are_split_by_team_and_season(spark):
    stays = [(1, "Quill, A.", "A", 25, 26), (1, "Quill, A.", "B", 27, 28), (2, "quill, a", "B", 25, 26), (3, "Other, O.", "A", 25, 28), (4, "Quill (R), A.", "C", 25, 30), (5, "Quill, A.", "C", 26, 26)]
    roster = spark.createDataFrame(stays, "index_player_id long, name string, team string, first_season long, last_season long")
    rows = [(25, "Quill, A.", "A", "#1"), (27, "Quill, A.", "B", "#1"), (26, "Quill (C), A.", "B", "#2"), (29, "Quill, A.", "B", "B"), (26, "Quill, A.", "C", "C"), (27, "Quill, A.", "C", "#4"), (25, "Quill, A.", None, None), (25, "Other, O.", "Z", "")]
    keyed = I.with_player_key(spark.createDataFrame([(s, 1, i, "passer", n, t) for i, (s, n, t, _) in enumerate(rows)], "season long, game_id long, play_index long, role string, name string, team string"))
    got = {r.play_index: r.player_key for r in I.split_by_roster(keyed, roster).collect()}
    assert [got[i] for i in range(len(rows))] == ["other, o" if w == "" else "quill, a" if w is None else f"quill, a|{w}" for *_, w in rows]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    names = [(i, f"{a}{b}, {c}.", 25 + i % 3) for i, (a, b, c) in enumerate((a, b, c) for a in ("Mc", "Van ", "ÉT") for b in ("Dor", "ando", "do") for c in "AB")] + [(90, None, 25), (91, "x", 25), (92, "%_a", 26)]
    names = spark.createDataFrame(names, "player_id long, name string, season long")
    people = names.select("player_id", "name", F.lit(20).alias("first_season"), F.lit(30).alias("last_season"))
    path = f"file://{tmp_path}/index"
    I.write_name_index(names, path, parts=8)
    for text in ("ando", "DOR", "van d", "ét", "x", "o, a", "nothing", "%_a", "éta"):
        for season in (None, 26):
            got, want = (sorted(r.player_id for r in df.collect()) for df in (I.search_index(spark, path, people, names, text, season, None, parts=8), I.search_players(people, names, text, season, None)))
            assert got == want, text
    plan = I.search_index(spark, path, people, names, "ando", parts=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "gram" in plan


def test_empty_identity(spark):
    assert I.players(_keyed(spark, [])).count() == 0


def test_merges_and_rosters(spark):
    people = spark.createDataFrame([(1, "Sorel, J.", 25, 26, 3), (4, "sorel, j", 27, 28, 2), (5, "Mc Vane Jr., W.", 25, 25, 1)], "player_id long, name string, first_season int, last_season int, mentions long")
    twins = I.duplicates(people)
    assert [(r.kept, r.removed) for r in twins.collect()] == [(1, [4])]
    merged = {r.player_id: r for r in I.merge_people(people, twins.select("kept", F.explode("removed").alias("removed"))).collect()}
    assert (merged[1].name, merged[1].first_season, merged[1].last_season, merged[1].mentions) == ("Sorel, J.", 25, 28, 5)
    plays = spark.createDataFrame([(4, None), (5, 4)], "passer_id long, rusher_id long")
    assert sorted(map(tuple, I.merge_ids(plays, spark.createDataFrame([(4, 1)], "removed long, kept long"), ("passer_id", "rusher_id")).collect()), key=str) == [(1, None), (5, 1)]
    roster = spark.createDataFrame([("Will Mc Vane Jr.",), ("Nobody Here",), ("",)], "name string")
    assert {r.name: r.player_id for r in I.match_roster(roster, people).collect()} == {"Will Mc Vane Jr.": 5, "Nobody Here": None, "": None}


def test_name_keys(spark):
    df = spark.createDataFrame([("Jean Claude Tarn Jr.",), ("de la Rosa III, M.",), ("Cher (R)",)], "n string")
    got = [tuple(r) for r in df.select(initial_last(F.col("n")), roster_key(F.col("n"), False), roster_key(F.col("n"), True)).collect()]
    assert got == [("jr, j", "claude tarn jr|j", "tarn|j"), (None, "de la rosa iii|m", "de la rosa|m"), (None, "cher|c", "cher|c")]


def test_play_pages(spark):
    row = lambda *c: "<tr>" + "".join(f"<td class='f'>{x}</td>" for x in c) + "</tr>"
    html = "<table class='Grid'>" + row("", "9:00", "", "", "first of all") + row("", "", "", "", "goes on") + row("", "", "", "", "Punt by X") + row("a", "b") + "<tr><th>Second Quarter</th></tr>" + row('<img src="/6_s.png">', "12:00", "1st and 10", "PLH - 25", "<b>run</b>") + "</table>"
    df = spark.createDataFrame([(1, html), (2, "<p>no table</p>"), (3, None)], "id long, html string")
    got = [(r.quarter, r.team_id, r.c, r.m) for r in P.play_rows(df, "id").orderBy("play_index").collect()]
    assert got == [(1, None, "9:00", "first of all<br/>goes on"), (1, None, "", "Punt by X"), (2, None, "15:00", "Second Quarter"), (2, 6, "12:00", "run")]
    assert P.links(df, "id").count() == 0 and P.roster_rows(df, "id").count() == 0 and P.team_stats(df, "id").count() == 0


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 3, 5), (2, "b", 1, 1)], "id long, name string, first int, last int")
    new = spark.createDataFrame([(1, "z", 4, 9), (3, "c", 2, 2)], "id long, name string, first int, last int")
    assert sorted(map(tuple, T.upsert(old, new, "id", widen=("first", "last")).collect())) == [(1, "z", 3, 9), (2, "b", 1, 1), (3, "c", 2, 2)]
    path = f"file://{tmp_path}/box"
    spark.createDataFrame([('{"id": 5, "aPassing": "310", "hPassing": 200, "aComp": "x"}',)], "value string").write.text(path)
    got = {r.side: (r.passing, r.comp) for r in T.read_box_scores(spark, path, multi_line=False).collect()}
    assert got == {"away": (310, None), "home": (200, None)}
    with pytest.raises(ValueError):
        T.export(old, f"file://{tmp_path}/x.txt")


def _rows(spark, n=600):
    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    df = spark.range(n).select(F.col("id").alias("game_id"), (25 + F.col("id") % 5).cast("int").alias("season"), F.lit("pass").alias("play_type"), F.lit("x").alias("description"), F.lit(10).alias("yard_line"), (1 + r(1, 4)).alias("down"), (1 + r(2, 15)).alias("distance"), (1 + r(3, 99)).alias("yl100"), (r(4, 29) - 14).alias("score_differential"), r(5, 1800).alias("half_seconds_remaining"), r(6, 2).alias("is_home"), F.lit(0).alias("is_overtime"))
    return df.withColumn("drive_points", F.col("yl100") / 20).withColumn("next_score", F.when(F.col("yl100") > 60, "td_pos").when(F.col("yl100") > 30, "no_score").otherwise("fg_neg")).withColumn("weight", F.lit(1.0))


def test_models_learn(spark, tmp_path):
    rows = _rows(spark).cache()
    size = {"iterations": 3, "depth": 3, "min_leaf": 5}
    models = M.fit_eras(rows, **size)
    got = M.evaluate_regression(M.with_model_ep(rows, models), prediction="ep_model").collect()[0]
    assert got.n == 600 and got.mae < 0.4 and got.r2 > 0.85
    path = f"file://{tmp_path}/models"
    M.save_eras(models, path)
    assert M.load_era(path, "2016").transform(rows.limit(1)).count() == 1
    with pytest.raises(Exception, match="no model for season"):
        M.with_model_ep(rows, {"2022": models["2022"]}).agg(F.sum("ep_model")).collect()
    soft = M.logistic_probabilities(M.fit_logistic(rows), rows)
    assert M.log_loss(soft).collect()[0].log_loss < 0.3
    rows = rows.withColumn("engine_era", F.lit(1))
    size = {"iterations": 12, "depth": 2, "min_leaf": 5}
    labels = M.fit_labels(rows, **size)
    assert len(labels.rounds) == 12 and M.log_loss(M.label_probabilities(labels, rows)).collect()[0].log_loss < 0.5
    hard = M.calibrated_probabilities(M.fit_calibrated(rows, folds=2, **size), rows)
    assert M.log_loss(hard).collect()[0].log_loss < 0.2
    assert hard.select(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1))).collect()[0][0] < 1e-9
    ep = hard.select(M.points_of(F.col("probabilities")).alias("ep"), "yl100").agg(F.avg(F.when(F.col("yl100") > 60, F.col("ep"))), F.avg(F.when(F.col("yl100") <= 30, F.col("ep")))).collect()[0]
    assert ep[0] > 6 and ep[1] < -2
    rows.unpersist()


def test_reconcile_and_heat(spark):
    a = spark.createDataFrame([(1, "A", 5), (1, "B", 6), (2, "A", None)], "game_id long, team string, yards long")
    b = spark.createDataFrame([(1, "A", 5), (1, "B", 7), (2, "A", None)], "game_id long, team string, yards long")
    r = L.reconcile(a, b, ("yards",)).collect()[0]
    assert (r.compared, r.same) == (3, 2) and math.isclose(r.match_rate, 2 / 3)
    assert [x.heat for x in L.with_heat(a.where("yards is not null").withColumn("k", F.lit(1)), "yards", "k").collect()] == [1.0, 1.0]


def test_filled_distance(spark):
    df = spark.createDataFrame([("1st and Goal", 7), ("4th and inches", 9), ("2nd and 8", 3), ("---", 2), (None, 1)], "t string, y int")
    assert [r[0] for r in df.select(filled_distance(F.col("t"), F.col("y"))).collect()] == [7, 1, 8, None, None]


VIEW = "game_id long, play_index long, play_type string, possession_team_id long, yard_line int, yard_line_team string, home_team string, away_team string, quarter int, clock string, half int, down int, first_down boolean, touchdown boolean, fg_good boolean, interception boolean, fumble_lost boolean, safety boolean, yards_gained int, epa double"


def _view(at, kind, team, line, side, down=None, half=1, game=1, **flags):
    f = {"first_down": None, "touchdown": None, "fg_good": None, "interception": None, "fumble_lost": None, "safety": None} | flags
    return (game, at, kind, team, line, side, "H", "A", half * 2, f"{at}:00", half, down, *f.values(), 5, 0.5)


def test_game_drives(spark):
    rows = [
        _view(0, "kickoff", 1, None, None), _view(1, "rush", 2, 25, "H", 1), _view(2, "pass", 2, 40, "A", 2, touchdown=True), _view(3, "kickoff", 2, None, None), _view(4, "field_goal", 1, 30, "H", 4, fg_good=False),
        _view(5, "timeout", None, None, None), _view(6, "rush", 1, 20, "A", 4, half=2), _view(7, "punt", 2, 20, "A", 4, half=2, first_down=True),
        _view(0, "rush", None, 20, "X", 1, game=2),
    ]
    df = spark.createDataFrame(rows, VIEW)
    got = [(r.game_id, r.drive, r.team, r.start_clock, r.start_yards, r.result, r.n_plays, r.yards, r.epa) for r in D.game_drives(df).orderBy("game_id", "drive").collect()]
    assert got == [
        (1, 1, "A", "0:00", None, "Punt / End", 0, 0, 0.0), (1, 2, "H", "1:00", 25, "TD", 2, 10, 1.0), (1, 3, "H", "3:00", None, "Punt / End", 0, 0, 0.0), (1, 4, "A", "4:00", 70, "Missed FG", 1, 5, 0.5), (1, 5, None, "5:00", None, "Punt / End", 0, 0, 0.0),
        (1, 6, "A", "6:00", 20, "Turnover on Downs", 1, 5, 0.5), (1, 7, "H", "7:00", None, "Punt / End", 0, 0, 0.0), (2, 1, None, "0:00", 20, "Punt / End", 1, 5, 0.5),
    ]
    bare = spark.createDataFrame([_view(0, "kickoff", 5, None, None), _view(1, "rush", 4, 9, None)], VIEW)
    assert {r.possession_team_id: r.team for r in D.game_team_map(bare).collect()} == {5: "A", 4: "H"}
    assert D.game_drives(df.limit(0)).count() == 0


def test_backfill(spark):
    rows = [(1, "A", 20, 1, "10:00", None, None), (1, "B", 20, 4, "1:05", None, None), (2, "A", 20, 5, "1:00", None, 7), (1, None, 20, 1, None, 11, None), (None, "A", 20, None, "x", None, None)]
    df = spark.createDataFrame(rows, "possession_team_id long, yard_line_team string, yard_line int, quarter int, clock string, half_seconds int, yl100 int")
    names = spark.createDataFrame([(1, ["A", "OLD"])], "id long, teams array<string>")
    got = sorted(((r.half_seconds, r.yl100) for r in D.backfill(df, names).collect()), key=str)
    assert got == sorted([(1500, 20), (65, 80), (0, 7), (11, None), (None, None)], key=str)


def test_rosters_search_and_profiles(spark):
    people = spark.createDataFrame([(1, "Sorel, J.", 25, 26), (2, "Jones, K.", 26, 28)], "player_id long, name string, first_season int, last_season int")
    names = spark.createDataFrame([(1, "Sorel, J.", 25), (1, "John SOREL", 26), (2, "Jones, K.", 26)], "player_id long, name string, season int")
    find = lambda **k: [r.player_id for r in I.search_players(people, names, **k).collect()]
    assert (find(name="sorel"), find(name="john", season=25), find(season=27), find(limit=1)) == ([1], [], [2], [1])
    careers = {"passing": spark.createDataFrame([(1, 30, 2)], "player_id long, yards long, games long")}
    one = I.player_profiles(people, names, careers, 1).collect()[0]
    assert [a.name for a in one.aliases] == ["Sorel, J.", "John SOREL"] and one.passing.yards == 30
    assert I.player_profiles(people, names, careers, 2).collect()[0].passing is None
    with pytest.raises(ValueError, match="no player 9"):
        I.player_profiles(people, names, careers, 9)
    roster = spark.createDataFrame([("a", 1, "OWN", 7, "x"), ("b", 2, None, 7, "x"), ("c", None, None, 8, "Full Name"), ("d", None, "", None, None)], "k string, player_id long, team string, team_id long, team_name string")
    got = I.roster_teams(roster, spark.createDataFrame([(1, "PLAY")], "player_id long, team string"), spark.createDataFrame([(7, "IDS")], "id long, team string"), spark.createDataFrame([("Full Name", "FN")], "team_name string, team string"))
    assert {r.k: (r.team, r.matched) for r in got.collect()} == {"a": ("PLAY", True), "b": ("IDS", True), "c": ("FN", False), "d": (None, False)}


def test_season_lists():
    assert T.season_list(50) == [50] and T.season_list(season_range="50-52") == [50, 51, 52]
    for bad in ({}, {"season": 1, "season_range": "1-2"}, {"season_range": "5"}):
        with pytest.raises(ValueError):
            T.season_list(**bad)


@pytest.mark.parametrize(("name", "fit", "size"), [("m1_drive_model", "fit_eras", {}), ("c1_model_epa", "fit_eras", {}), ("m2_label_models", "fit_boosted", M.ITERATIONS), ("m4_calibrated_labels", "fit_boosted", M.ITERATIONS)])
def test_model_queries_and_their_split(spark, monkeypatch, name, fit, size):
    """Models fit at the operators' size, and none on a season of the split but 25."""
    from downfield.plans import models as Q

    class Asked(Exception):
        pass

    def asked_for(rows, *args, **given):
        raise Asked({r[0] for r in rows.select("season").distinct().collect()}, given.get("iterations", given))

    monkeypatch.setattr(M, fit, asked_for)
    with pytest.raises(Asked) as asked:
        getattr(Q, name)(spark, "/root/testdata/sf0.001")
    assert asked.value.args == ({25, 28, 29}, size)


NEXT = "game_id long, play_index long, possession_team_id long, play_type string, touchdown boolean, interception boolean, fumble_lost boolean, safety boolean, fg_good boolean, pts int, half int"


def test_next_scores(spark):
    """Names play no part; a touchdown after a turnover counts for the side in possession; a safety for the other id."""
    rows = [
        (1, 0, 7, "rush", False, False, False, False, None, None, 1), (1, 1, None, "timeout", False, False, False, False, None, None, 1), (1, 2, 4, "pass", True, True, False, False, None, -7, 1),
        (1, 3, 7, "sack", False, False, False, True, None, -2, 1), (1, 4, 4, "rush", False, False, False, False, None, None, 1),
        (1, 5, 4, "field_goal", False, False, False, False, True, 3, 2), (2, 0, 9, "sack", False, False, False, True, None, -2, 1),
    ]
    got = [r.next_score for r in D.with_next_score(spark.createDataFrame(rows, NEXT)).orderBy("game_id", "play_index").collect()]
    assert got == ["td_neg", "td_neg", "td_pos", "safety_neg", "no_score", "fg_pos", "safety_neg"]


def test_box_scores_know_tries_as_written_and_first_known_teams(spark):
    rows = [(1, 0, "Pass by A, complete to B for 3 yds. 2 point conversion", None), (1, 1, "Pass by A, complete to B for 3 yds. Conversion", None), (1, 2, "Pass by A, complete to B for 4 yds", "X"), (1, 3, "Pass by A to B falls incomplete", "Y")]
    df = spark.createDataFrame(rows, "game_id long, play_index long, description string, possession_team string").withColumns({"play_type": F.lit("pass"), "passer_id": F.lit(5), "yards_gained": F.lit(3), "touchdown": F.lit(False), "interception": F.lit(False)})
    got = S.player_passing(df).collect()[0]
    assert (got.att, got.comp, got.team) == (3, 2, "X")


def test_clocks_that_cannot_be_read(spark):
    df = spark.createDataFrame([(1, "x:y"), (5, "x:y"), (5, "3:00"), (3, "1:05"), (None, "1:00"), (2, None)], "q int, c string")
    got = [tuple(r) for r in df.select(half_seconds(F.col("q"), F.col("c")), loaded_half_seconds(F.col("q"), F.col("c"))).collect()]
    assert got == [(0, None), (0, None), (0, 0), (965, 965), (60, None), (0, None)]
    rows = spark.createDataFrame([(1, "A", 20, 1, "x:y", None, None)], "possession_team_id long, yard_line_team string, yard_line int, quarter int, clock string, half_seconds int, yl100 int")
    assert D.backfill(rows, spark.createDataFrame([(1, ["A"])], "id long, teams array<string>")).collect()[0].half_seconds is None


def test_curves_leave_small_groups_out(spark):
    df = spark.createDataFrame([(1, 3, 0.5, 0.2, "pass")] * 4 + [(2, 3, 0.5, -0.2, "sack")] * 2, "down int, distance int, ep_before double, epa double, play_type string").withColumn("yl100", F.lit(42))
    assert [(r.down, r.n) for r in C.points_by_distance(df, at_least=3).collect()] == [(1, 4)]
    assert [(r.yards, r.n) for r in C.points_by_yards(df, at_least=4).collect()] == [(40, 4)]
    assert [(r.down, r.kind, r.success_rate) for r in C.success_by_down(df, at_least=2).orderBy("down").collect()] == [(1, "pass", 1.0), (2, "pass", 0.0)]


def test_merges_follow_chains(spark):
    merges = spark.createDataFrame([(3, 2), (2, 1), (5, 4), (9, 9)], "removed long, kept long")
    assert {r.removed: r.kept for r in I.followed(merges).collect()} == {3: 1, 2: 1, 5: 4}
    with pytest.raises(ValueError, match="circle"):
        I.followed(spark.createDataFrame([(1, 2), (2, 1)], "removed long, kept long"))
    names = spark.createDataFrame([(1, "a", 25), (2, "b", 25), (2, "c", 26), (7, "d", 26)], "player_id long, name string, season int")
    got = sorted(map(tuple, I.moved_rows(names, I.followed(merges), "season").collect()))
    assert got == [(1, "a", 25), (1, "c", 26), (7, "d", 26)]
    assert [r.player_id for r in I.without_removed(names, I.followed(merges)).collect()] == [7]


def test_lists_and_unknown_categories(spark):
    df = spark.createDataFrame([(1, k, 25 + k % 2, "pass", k) for k in range(6)], "game_id long, play_index long, season int, play_type string, passer_id long").withColumns({f"{r}_id": F.lit(None).cast("long") for r in ("rusher", "receiver", "tackler", "sacker", "interceptor")})
    assert [r.play_index for r in L.play_list(df, season=25, offset=1, limit=1).collect()] == [2]
    assert [r.play_index for r in L.play_list(df, player_id=4).collect()] == [4]
    with pytest.raises(ValueError, match="kicking"):
        L.game_logs(df, "kicking")
    rows = spark.createDataFrame([("3-1", 1), ("10-0-1", 1), (None, 1)], "record string, k int")
    assert {r.record: r["rank"] for r in L.ranked_by(rows, "record", "k").collect()} == {"10-0-1": 1, "3-1": 2, None: 3}


def test_defensive_aliases_and_upserts(spark):
    keyed = spark.createDataFrame([("tackler", "Sorel, J.", "sorel, j"), ("passer", "Sorel, J.", "sorel, j"), ("sacker", "Jon Sorel", "jon sorel"), ("tackler", "Nobody, N.", "nobody, n")], "role string, name string, player_key string")
    aliases = spark.createDataFrame([("Sorel, J.", "Jon Sorel"), ("Nobody, N.", "Not There")], "name string, canonical string")
    assert sorted(map(tuple, I.with_defensive_keys(keyed, aliases).collect())) == [("passer", "Sorel, J.", "sorel, j"), ("sacker", "Jon Sorel", "jon sorel"), ("tackler", "Nobody, N.", "nobody, n"), ("tackler", "Sorel, J.", "jon sorel")]
    old, new = (spark.createDataFrame(r, "id long, season int, kind string") for r in ([(1, 5, "a")], [(1, 6, "b"), (2, 7, "c")]))
    assert sorted(map(tuple, T.upsert(old, new, "id", only=("kind",)).collect())) == [(1, 5, "b"), (2, 7, "c")]
    twice = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "game_id long, play_index long")
    assert [tuple(r) for r in T.repeated_plays(twice).collect()] == [(1, 1, 2)]
