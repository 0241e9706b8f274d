"""Play operators: text cases, invariants, and all queries against their SQL."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from downfield.functions.names import last_first, normalized
from downfield.functions.parse import down_distance, field_position, parse_plays, score, typed_plays
from downfield.operators import drives as D
from downfield.registry import ORACLE_SQL, QUERIES
from downfield.sources.projection import plays, projected
from downfield.sources.store import LEAST_BUCKETS

SF = "/root/testdata/sf0.001"

CASES = [
    ("Pass by Vellar, N., complete to Osk, T. for 3 yds. Tackle by Brandt, U..", "pass", {"passer": "Vellar, N.", "receiver": "Osk, T.", "yards_gained": 3, "tackler": "Brandt, U."}),
    ("Pass by A, J., complete to B, M. for a short gain. Tackle by P, P..", "pass", {"yards_gained": 0}),
    ("Rush by Ilves, R. for -1 yds. Tackle by P, P..", "rush", {"rusher": "Ilves, R.", "yards_gained": -1}),
    ("Vellar, N. is SACKED by Piet Harlow - DT for -11 yds.", "sack", {"passer": "Vellar, N.", "sacker": "Piet Harlow", "yards_gained": -11}),
    ("Kickoff by Ostrov, K. through the back of the endzone. Touchback.", "kickoff", {"kicker": "Ostrov, K."}),
    ("Kickoff of 62 yards. Returned by Marle (C), V. for 10 yards.", "kickoff", {"kick_yards": 62, "returner": "Marle (C), V.", "yards_gained": 10}),
    ("Punt by Tindel (R), H. of 33 yards.", "punt", {"kick_yards": 33}),
    ("18 yard FG by Ostrov, K. is NO good.", "field_goal", {"fg_distance": 18, "fg_good": False}),
    ("Pass by X, Y., to Fenn, L..<br/> INTERCEPTION by Brandt, U. at the PLH - 42 yard line and returned for 14 yards.<br/>First Down!", "pass", {"receiver": "Fenn, L", "interceptor": "Brandt, U.", "first_down": True}),
    ("Herons Penalty on Quill, B.: Delay of Game.", "penalty", {"penalty_team": "Herons", "penalty_type": "Delay of Game"}),
    ("Offense kneels the ball.", "kneel", {}),
    ("15:00 - First Quarter", "quarter_marker", {}),
    ("Timeout called by PLH", "timeout", {}),
    ("Port Lune Herons : Timeout", "timeout", {}),
    ("Corwen, D. throws the ball away to avoid the sack.", "pass", {"passer": "Corwen, D."}),
    ("nothing of the kind", "unknown", {}),
    ("Pass by A, J. to B, M. is incomplete. Broken up by Otto van Rhee II..", "pass", {"passer": "A, J.", "receiver": "B, M.", "tackler": "Otto van Rhee II.", "yards_gained": 0}),
    ("Punt by R, T. of 41 yards. Returned by D, Z. for 12 yards.", "punt", {"returner": "D, Z.", "yards_gained": 12}),
    ("Kickoff by W, W. of 60 yards. A 92 yard return by D. TOUCHDOWN! (W, W. kick NO GOOD)", "kickoff", {"yards_gained": 92, "returner": None, "touchdown": True, "pat_good": False}),
    ("Rush by X, Y. for 4 yds. Tackle by Piet Harlow.<br/>FUMBLE recovered by Q, R. at the PLH - 30 yard line and returned for 4 yards.", "rush", {"tackler": "Piet Harlow", "fumble": True, "fumble_lost": True, "fumble_recoverer": "Q, R.", "fumbler": None}),
    ("Rush by X, Y. for 4 yds.<br/>FUMBLE by X, Y., recovered by Z, Y..", "rush", {"fumble": True, "fumble_lost": False, "fumbler": "X, Y.", "fumble_recoverer": "Z, Y."}),
    ("Pass by X, Y., to Fenn, L..", "unknown", {"interception": False}),
    ("X, Y. is SACKED by S, T. - DT for -8 yds. Tackle by U, V.. Safety! Automatic First Down", "sack", {"tackler": None, "safety": True, "first_down": True, "auto_first_down": True}),
    ("Turnover on downs.", "pass", {"turnover_on_downs": True, "yards_gained": 0}),
]


def test_texts(spark):
    rows = parse_plays(spark.createDataFrame([(c[0],) for c in CASES], "description string")).collect()
    by = {r.description: r for r in rows}
    for text, kind, fields in CASES:
        assert by[text].parsed_type == kind
        assert {k: by[text][f"parsed_{k}"] for k in fields} == fields


def test_small_fields(spark):
    c = F.col("t")
    df = spark.createDataFrame([("2nd and 7",), ("4th and inches",), ("PLH - 25",), ("KDR 24 - PLH 17",), ("---",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*down_distance(c), *field_position(c), *score(c)).collect()]
    assert got[0][:3] == (2, 7, "7") and got[1][:3] == (4, None, "inches") and got[2][3:5] == ("PLH", 25) and got[3][5:] == ("KDR", 24, "PLH", 17)
    assert all(x is None for r in got[4:] for x in r)


def test_typed_rows(spark):
    rows = [(1, 0, 2, 7, "KDR 3 - PLH 0", "9:00", "1st and Goal", "PLH - 4", "Rush by A, B. for a short gain.", "c"), (1, 1, 2, None, None, None, None, None, None, None)]
    first, none = typed_plays(spark.createDataFrame(rows, "game_id long, play_index long, quarter int, possession_team_id int, s string, c string, t string, o string, m string, css string")).orderBy("play_index").collect()
    assert (first.down, first.distance, first.distance_text, first.yard_line_team, first.yard_line, first.away_team, first.score_home, first.rusher, first.yards_gained) == (1, 4, "Goal", "PLH", 4, "KDR", 0, "A, B.", 0)
    assert (none.play_type, none.description, none.down, none.touchdown, none.rusher) == ("unknown", "", None, False, None)


def test_names(spark):
    df = spark.createDataFrame([(" Smith (R) ,  J.",), ("John Smith Jr.",), ("Smith",)], "n string")
    got = df.select(normalized(F.col("n")), last_first(F.col("n"))).collect()
    assert got[0][0] == "smith, j" and got[1][1] == "smith jr, j" and got[2][1] is None


def test_order_of_rows_changes_nothing(spark):
    base = plays(spark, SF)
    a = D.with_epa(D.with_context(base)).select("game_id", "play_index", "epa")
    b = D.with_epa(D.with_context(base.orderBy(F.rand(3)).repartition(3))).select("game_id", "play_index", "epa")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_epa_telescopes(spark):
    """Within a drive the values of EPA sum up to its points, or to nothing, less the first value."""
    rows = D.with_epa(D.with_drives(D.with_context(plays(spark, SF)))).where("epa is not null").orderBy("game_id", "play_index").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.game_id, r.drive), []).append(r)
    told = 0
    for got in groups.values():
        for x, y in zip(got, got[1:], strict=False):
            if x.pts is None and x.ep_after:  # the value of the next play, if the drive goes on
                assert x.ep_after == y.ep_before
                told += 1
        whole = sum(r.epa for r in got)
        breaks = sum(y.ep_before - x.ep_after for x, y in zip(got, got[1:], strict=False))
        assert math.isclose(whole, got[-1].ep_after - got[0].ep_before - breaks, abs_tol=1e-9)
    assert told > 50


def test_no_exchange(spark):
    """The stored plays are dealt by game: windows over games move no row, in as many tasks as there are buckets; one exchange if they come from elsewhere."""
    rows = plays(spark, SF)
    windows = lambda df: D.with_epa(D.with_drives(D.with_context(df)))
    plan = windows(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 and "Python" not in plan
    assert windows(rows).rdd.getNumPartitions() == LEAST_BUCKETS
    assert windows(projected(spark, SF))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_seasons_are_pruned(spark):
    plan = QUERIES["f18_season_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*season", plan), plan


@pytest.mark.parametrize(("name", "most"), [("r2_players", 10), ("r5_aliases", 10), ("r7_play_ids", 10), ("a1_player_passing", 1), ("a5_team_games", 1)])
def test_exchanges(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= most, plan


@pytest.mark.parametrize("name", ["a1_player_passing", "a5_team_games", "q17_offense_dashboard", "q19_passing_leaderboard", "q8_player_profiles"])
def test_code_is_generated(spark, name):
    """No stage of the plan grows beyond what the JVM compiles."""
    df = QUERIES[name](spark, SF)
    stages = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    for i in range(stages.size()):
        assert stages.apply(i)._3().maxMethodCodeSize() >= 0


def _number(x):
    return isinstance(x, float) or type(x).__name__ == "Decimal"


def _same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if _number(a) and b is not None else a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    """Row by row: rows are put in order by all that is not a float, then by rounded floats."""
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda r: tuple(float(x) if _number(x) else x for x in r)
    got, want = [plain(r) for r in df.select(cols).collect()], [plain(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()]
    floats = {i for r in (*got, *want) for i, x in enumerate(r) if _number(x)}
    key = lambda r: ([str(x) for i, x in enumerate(r) if i not in floats], [-1e300 if x is None else round(x, 5) for i, x in enumerate(r) if i in floats])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(map(_same, a, b)), (a, b)
