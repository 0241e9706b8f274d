"""The stored plays, refreshes and merges touch what changed and nothing else; pages with references and tables within tables."""

import os
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from downfield import registry  # noqa: F401  all queries, in their order
from downfield.operators import drives as D
from downfield.operators.games import fourth_downs
from downfield.plans.sources import DERIVED
from downfield.sources import pages as P
from downfield.sources import refresh as R
from downfield.sources import store as S
from downfield.sources import tables as T
from downfield.sources.projection import plays

SF = "/root/testdata/sf0.001"


def stamps(path):
    """Time of the last change of every data file."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store_is_dealt_sorted_and_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/plays"
    rows = plays(spark, SF)
    stored = S.write_store(rows, path, 4)
    assert stored.exceptAll(rows.select(stored.columns)).isEmpty() and stored.count() == rows.count()
    for f in stamps(tmp_path):
        if "/plays/" in f:
            got = [(r.game_id, r.play_index) for r in spark.read.parquet(f"file://{f}").select("game_id", "play_index").collect()]
            assert got == sorted(got)
    spark.sql(f"DROP TABLE {S.store_name(path)}")  # as in another session
    again = S.open_store(spark, path)
    assert again.count() == rows.count()
    plan = D.with_context(S.seasons_of(spark, path, [26])).groupBy("game_id").agg(F.sum("yards_gained"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(season" in plan
    with pytest.raises(AnalysisException):
        S.open_store(spark, f"{path}-none")


def test_replaced_partitions_leave_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/plays"
    S.write_store(plays(spark, SF), path, 4)
    before = stamps(tmp_path)
    given = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    S.replace_partitions(plays(spark, SF).where("season = 27 AND play_index < 5"), path)
    assert S.seasons_of(spark, path, [27]).count() == 5 * S.seasons_of(spark, path, [27]).select("game_id").distinct().count()
    after = stamps(tmp_path)
    assert all(after[f] == t for f, t in before.items() if "season=27" not in f) and S.open_store(spark, path).count() < plays(spark, SF).count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == given


def test_refresh_touches_the_last_files_and_their_seasons(spark, tmp_path):
    folder = f"file://{tmp_path}/all"
    base = plays(spark, SF)
    rows = base.unionByName(base.withColumn("game_id", F.col("game_id") + 5)).unionByName(base.withColumns({"game_id": F.col("game_id") + 10, "season": F.col("season") + 5}))
    half = rows.where(~(F.col("season") >= 33) | (T.bucket(F.col("game_id")) <= 8))
    two = {k: DERIVED[k] for k in ("play_epa", "team_epa")}
    R.build_season_tables(half, folder, two, 4)
    before = stamps(tmp_path)
    time.sleep(0.01)
    R.refresh_last(rows, folder, [33, 34], two)
    after = stamps(tmp_path)
    changed = {f.replace(str(tmp_path), "") for f in {*before, *after} if before.get(f) != after.get(f)}
    assert changed and all("season=33" in f or "season=34" in f for f in changed)
    assert all("file=9" in f or "file=10" in f for f in changed if "/plays/" in f)
    R.build_season_tables(rows, f"{folder}-whole", two, 4)
    for name in ("plays", *two):
        read = lambda at: spark.read.parquet(f"{at}/{name}").select(*(c for c in spark.read.parquet(f"{folder}/{name}").columns if not c.endswith("epa") and c != "success_rate"))  # noqa: B023, E731
        assert read(folder).exceptAll(read(f"{folder}-whole")).isEmpty() and read(f"{folder}-whole").exceptAll(read(folder)).isEmpty()


def test_upserts_touch_the_parts_they_hit(spark, tmp_path):
    path = f"file://{tmp_path}/people"
    R.write_dimension(spark.range(500).select("id", F.lit(25).alias("first_season"), F.lit(25).alias("last_season"), F.lit("old").alias("name")), path, "id", parts=16)
    before = stamps(tmp_path)
    new = spark.createDataFrame([(3, 20, 29, "new"), (900, 28, 28, "new"), (3, 22, 30, "later")], "id long, first_season int, last_season int, name string")
    hit = R.upsert_dimension(spark, path, new, "id", parts=16, widen=("first_season", "last_season"))
    after = stamps(tmp_path)
    assert 1 <= len(hit) <= 2 and all(after[f] == t for f, t in before.items() if not any(f"part={p}/" in f for p in hit))
    got = {r.id: r for r in R.read_dimension(spark, path).collect()}
    assert len(got) == 501 and (got[3].first_season, got[3].last_season) == (20, 30) and got[3].name in ("new", "later") and got[900].name == "new" and got[4].name == "old"


def test_text_of_cells(spark):
    cases = {
        "O&#39;Neil &amp; Co": "O'Neil & Co", " &nbsp;A <b> B</b>\n": "AB", "&lt;td&gt; &copy; &eacute;": "<td> © é", "&#x1F600;&#8364;&#146;": "😀€’", "AT&T &unknown; &": "AT&T &unknown; &", "a<!-- x < y -->b": "ab",
        "&#0;&#xD800;&#1114112;": "���", "&amp;lt;": "&lt;", "": "", "plain": "plain",
    }
    df = spark.createDataFrame(list(cases.items()), "cell string, want string").select("cell", "want", P._text(F.col("cell")).alias("got"))
    for r in df.collect():
        assert r.got == r.want, r


def test_tables_within_tables(spark):
    inner = '<table><tr><td>Team Stats</td></tr><tr><td>Comp/Att</td><td><table><tr><td>1</td></tr></table>9/10</td><td>7/8</td></tr></table>'
    html = f"<TABLE id='x'><tr><td>Scoring</td></tr><tr><td>{inner}</td></tr></TABLE><table><tr><td>After</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<table><tr><td>open"), (3, None)], "id long, html string")
    got = {r.id: r.t for r in df.select("id", P.titled_table(F.col("html"), "Team Stats").alias("t")).collect()}
    assert got[1] == inner[: -len("</table>")] and got[2] is None and got[3] is None
    rows = [(r.id, r.row) for r in P.table_rows(df, "id").orderBy("id", "pos").collect()]
    assert [r for i, r in rows if i == 1][:3] == ["<tr><td>Scoring</td></tr>", "<tr><td><table></table></td></tr>", "<tr><td>Team Stats</td></tr>"] and rows[-1] == (2, "<tr><td>open")
    stats = {r.side: (r.comp, r.att) for r in P.team_stats(df.where("id = 1"), "id").collect()}
    assert stats == {"away": (9, 10), "home": (7, 8)}


def test_fourth_downs_of_an_unknown_side(spark):
    row = (4, "punt", 50, 1, "10:00", 7, 0, "H", "A")
    schema = "down int, play_type string, yl100 int, quarter int, clock string, score_home int, score_away int, home_team string, away_team string, possession_team string"
    df = spark.createDataFrame([(*row, "H"), (*row, "A"), (*row, None), (*row, "Z")], schema)
    n = lambda score: sum(r.n for r in fourth_downs(df, score=score, at_least=1).collect())
    assert (n("winning"), n("losing"), n("tied"), n("all")) == (1, 1, 0, 4)
