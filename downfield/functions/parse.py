"""Play texts to fields: one ordered CASE picks the rule, then groups of its pattern give the fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text formats, first match wins (fixed values): name, play type, a text that every such play holds, pattern, and the groups of its fields.
RULES: tuple[tuple[str, str, str, str, dict[str, int]], ...] = (
    ("quarter_marker", "quarter_marker", "", r"^\d+:\d+ - .*(?:Quarter|Half|Overtime|OVERTIME)|End of Game|00:00", {}),
    ("kickoff_touchback", "kickoff", "Kickoff by ", r"Kickoff by (.+?) (?:through the back|deep into the endzone)", {"kicker": 1}),
    ("kickoff_return", "kickoff", "Kickoff of ", r"Kickoff of (\d+) yards.*?Returned by (.+?) for (\d+) yards", {"kick_yards": 1, "returner": 2, "yards_gained": 3}),
    ("onside_recovery", "kickoff", "Recovered by", r"Onsides? Kickoff by (.+?)\. Recovered by", {"kicker": 1}),
    ("onside", "kickoff", "Kickoff by ", r"Onsides? Kickoff by (.+?) of (\d+) yards", {"kicker": 1, "kick_yards": 2}),
    ("free_kick", "kickoff", "Free Kick by ", r"Free Kick by (.+?) of (\d+) yards", {"kicker": 1, "kick_yards": 2}),
    ("kickoff_yards", "kickoff", "Kickoff by ", r"Kickoff by (.+?) of (\d+) yards", {"kicker": 1, "kick_yards": 2}),
    ("kicks_off", "kickoff", " kicks off", r"(.+?) kicks off", {"kicker": 1}),
    ("punt", "punt", "Punt by ", r"Punt by (.+?) of (\d+) yards", {"kicker": 1, "kick_yards": 2}),
    ("punt_blocked", "punt", "Punt by ", r"Punt by (.+?) is BLOCKED BY ([^<]+)\.(?=\.|<|\s|$)", {"kicker": 1}),
    ("field_goal", "field_goal", " yard FG by ", r"(\d+) yard FG by (.+?) is (good|NO good)", {"fg_distance": 1, "kicker": 2}),
    ("field_goal_blocked", "field_goal", " yard FG by ", r"(\d+) yard FG by (.+?) is BLOCKED by ([^<]+)\.(?=\.|<|\s|$)", {"fg_distance": 1, "kicker": 2}),
    ("sack", "sack", "SACKED by ", r"(.+?) (?:is )?SACKED by (.+?) - \w+ for (-?\d+) yds", {"passer": 1, "sacker": 2, "yards_gained": 3}),
    ("complete", "pass", ", complete to ", r"Pass by (.+?), complete to (.+?) for (?:(-?\d+) yds|a short gain)", {"passer": 1, "receiver": 2, "yards_gained": 3}),
    ("broken_up", "pass", "Broken up by ", r"Pass by (.+?) to (.+?) is incomplete\. Broken up by ([^<]+)\.(?=\.|<|\s|$)", {"passer": 1, "receiver": 2, "tackler": 3}),
    ("falls", "pass", " falls incomplete", r"Pass by (.+?) to (.+?) falls incomplete", {"passer": 1, "receiver": 2}),
    ("dropped", "pass", " was dropped", r"Pass by (.+?) to (.+?) was dropped", {"passer": 1, "receiver": 2}),
    ("intercepted", "pass", "INTERCEPTION by ", r"^(?=.*INTERCEPTION by .+? at .+? yard line and returned for -?\d+).*?Pass by (.+?),? to (.+?)\.\.", {"passer": 1, "receiver": 2}),
    ("rush", "rush", "Rush by ", r"Rush by (.+?) for (?:(-?\d+) yds|a short gain)", {"rusher": 1, "yards_gained": 2}),
    ("kneel", "kneel", "Offense kneels", r"Offense kneels", {}),
    ("spike", "spike", "spikes the ball", r"spikes the ball", {}),
    ("penalty_nullify", "penalty", "Play nullified by ", r"(?:Pass |Rush )?Play nullified by (.+?) Penalty on (.+?): (.+?)(?:\.|<)", {"penalty_team": 1, "penalty_type": 3}),
    ("penalty", "penalty", " Penalty on ", r"^(.+?) Penalty on (.+?): (.+?)(?:\.|$)", {"penalty_team": 1, "penalty_type": 3}),
    ("timeout", "timeout", "Timeout called by ", r"^Timeout called by \w+", {}),
    ("timeout_old", "timeout", "Timeout", r"^.+?\s*:\s*Timeout", {}),
    ("throwaway", "pass", " throws the ball away", r"(.+?) throws the ball away", {"passer": 1}),
    ("on_downs", "pass", "Turnover on downs", r"^Turnover on downs", {}),
    ("kickoff_touchdown", "kickoff", "TOUCHDOWN", r"^(?=.*TOUCHDOWN).*(?:kicks off|yard return)", {}),
)
#: Formats that hold a return, a tackle, or a play of no gain (fixed values).
_RETURNED = ("onside", "free_kick", "kickoff_yards", "punt", "punt_blocked")
_TACKLED, _NO_GAIN = ("complete", "rush"), ("complete", "rush", "broken_up", "falls", "dropped", "intercepted", "throwaway", "on_downs")
RETURN, RETURN_YARDS, TACKLE = r"Returned by (.+?) for (\d+) yards", r"A (\d+) yard return", r"Tackle by ([^<]+)\.(?=\.|<|\s|$)"
#: Outcomes that any text may tell besides (fixed values).
FUMBLE_LOST, FUMBLE_KEPT = r"FUMBLE recovered by (.+?) at .+? yard line and returned for \d+", r"FUMBLE by (.+?), recovered by ([^<]+)\.(?=\.|<|\s|$)"
INTERCEPTION, PAT = r"INTERCEPTION by (.+?) at .+? yard line and returned for -?\d+", r"(?i)\(.+? kick (good|no good)\)"
_TEXTS = ("passer", "rusher", "receiver", "tackler", "sacker", "kicker", "returner", "penalty_team", "penalty_type")
_NUMBERS = ("yards_gained", "kick_yards", "fg_distance")


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _rule(*names: str) -> Column:
    return F.col("rule").isin(*(k for k, r in enumerate(RULES) if r[0] in names))


def _has(text: Column, part: str, pattern: str) -> Column:
    """Whether the text has the pattern, which is tried only where its fixed part stands."""
    return text.contains(part) & text.rlike(pattern) if part else text.rlike(pattern)


def rule_of(text: Column) -> Column:
    """Number of the first rule whose pattern the text has; null if none."""
    return reduce(lambda c, k: c.when(_has(text, *RULES[k][2:4]), k), range(1, len(RULES)), F.when(_has(text, *RULES[0][2:4]), 0))


def parse_plays(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds parsed_type, rule, the fields of the primary action and the outcomes that any play may have."""
    d, df = F.col(text), df.withColumn("rule", rule_of(F.col(text)))

    def field(name: str) -> Column:
        of = [(k, r[4][name], r[3]) for k, r in enumerate(RULES) if name in r[4]]
        return reduce(lambda c, x: c.when(F.col("rule") == x[0], _group(d, x[2], x[1])), of[1:], F.when(F.col("rule") == of[0][0], _group(d, of[0][2], of[0][1])))

    types = reduce(lambda c, k: c.when(F.col("rule") == k, RULES[k][1]), range(1, len(RULES)), F.when(F.col("rule") == 0, RULES[0][1])).otherwise("unknown")
    cols = {f"parsed_{c}": field(c) for c in _TEXTS} | {f"parsed_{c}": field(c).try_cast("int") for c in _NUMBERS}
    told = F.when(_rule("kickoff_yards"), _group(d, RETURN_YARDS, 1))
    cols["parsed_returner"] = F.coalesce(cols["parsed_returner"], F.when(_rule(*_RETURNED) & told.isNull(), _group(d, RETURN, 1)))
    cols["parsed_tackler"] = F.coalesce(cols["parsed_tackler"], F.when(_rule(*_TACKLED), _group(d, TACKLE, 1)))
    cols["parsed_penalty_type"] = F.trim(cols["parsed_penalty_type"])
    back = F.when(_rule(*_RETURNED), F.coalesce(told, _group(d, RETURN, 2)).try_cast("int"))
    cols["parsed_yards_gained"] = F.coalesce(cols["parsed_yards_gained"], back, F.when(_rule(*_NO_GAIN), 0))
    pat = F.lower(F.when(F.lower(d).contains(" kick "), _group(d, PAT, 1)))
    lost, kept, picked = (_has(d, part, pattern) for part, pattern in (("FUMBLE recovered by ", FUMBLE_LOST), ("FUMBLE by ", FUMBLE_KEPT), ("INTERCEPTION by ", INTERCEPTION)))
    flags = {
        "parsed_touchdown": d.contains("TOUCHDOWN"),
        "parsed_interception": picked,
        "parsed_interceptor": F.when(picked, _group(d, INTERCEPTION, 1)),
        "parsed_fumble": lost | kept,
        "parsed_fumble_lost": lost,
        "parsed_fumbler": F.when(kept, _group(d, FUMBLE_KEPT, 1)),
        "parsed_fumble_recoverer": F.coalesce(F.when(kept, _group(d, FUMBLE_KEPT, 2)), F.when(lost, _group(d, FUMBLE_LOST, 1))),
        "parsed_safety": d.contains("Safety"),
        "parsed_first_down": d.contains("First Down"),
        "parsed_auto_first_down": d.contains("Automatic First Down"),
        "parsed_turnover_on_downs": d.contains("Turnover on downs"),
        "parsed_complete": d.contains(", complete to"),
        "parsed_fg_good": F.when(_rule("field_goal"), d.rlike(r"\d+ yard FG by .+? is good")).when(_rule("field_goal_blocked"), False),
        "parsed_pat_good": pat == "good",
    }
    return df.withColumn("parsed_type", types).withColumns(cols).withColumns(flags)


def typed_plays(raw: DataFrame) -> DataFrame:
    """Typed rows from the fields of the game files: place in the game, situation, score and all that the text tells.

    A null text is of type unknown and tells nothing.
    """
    texts = parse_plays(raw.withColumn("m", F.coalesce("m", F.lit(""))), "m")
    down, _, said = down_distance(F.col("t"))
    side, line = field_position(F.col("o"))
    away, away_points, home, home_points = score(F.col("s"))
    parsed = [c for c in texts.columns if c.startswith("parsed_") and c not in ("parsed_type", "parsed_complete")]
    return texts.select(
        "game_id", "play_index", "quarter", F.col("c").alias("clock"), away_points.alias("score_away"), home_points.alias("score_home"), away.alias("away_team"), home.alias("home_team"), "possession_team_id",
        down.alias("down"), filled_distance(F.col("t"), line).alias("distance"), said.alias("distance_text"), line.alias("yard_line"), side.alias("yard_line_team"), F.col("parsed_type").alias("play_type"),
        F.col("m").alias("description"), "css", (F.col("parsed_type") == "penalty").alias("penalty"), *(F.col(c).alias(c.removeprefix("parsed_")) for c in parsed),
    )


def down_distance(text: Column) -> tuple[Column, Column, Column]:
    """'2nd and 7' to 2, 7 and '7'; 'inches' and 'Goal' have no number."""
    pattern = r"^(\d)(?:st|nd|rd|th) and (\d+|inches|Goal)"
    said = _group(text, pattern, 2)
    return _group(text, pattern, 1).try_cast("int"), said.try_cast("int"), said


def field_position(text: Column) -> tuple[Column, Column]:
    """'SJS - 25' to 'SJS' and 25."""
    pattern = r"^(\w+) - (\d+)"
    return _group(text, pattern, 1), _group(text, pattern, 2).try_cast("int")


def score(text: Column) -> tuple[Column, Column, Column, Column]:
    """'NYS 3 - SJS 0' to 'NYS', 3, 'SJS' and 0."""
    pattern = r"^(\w+) (\d+) - (\w+) (\d+)"
    return _group(text, pattern, 1), _group(text, pattern, 2).try_cast("int"), _group(text, pattern, 3), _group(text, pattern, 4).try_cast("int")


def filled_distance(text: Column, yard_line: Column) -> Column:
    """Distance of a down text; to the goal it is the yard line, and inches are one yard."""
    _, distance, said = down_distance(text)
    return F.coalesce(distance, F.when(F.lower(said) == "goal", yard_line).when(F.lower(said) == "inches", 1))


def pattern_counts(df: DataFrame, patterns: dict[str, str], text: str = "description") -> DataFrame:
    """Rows by the first pattern that the text has ('other' for none), most common first."""
    label = reduce(lambda c, k: c.when(F.col(text).rlike(patterns[k]), k), patterns, F.when(F.lit(False), F.lit(""))).otherwise("other")
    return df.groupBy(label.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern")
