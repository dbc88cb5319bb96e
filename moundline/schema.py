"""The pitch table and its code tables, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

#: The columns of the stored table and their types, in order.
_COLUMNS = """
    game_pk long
    game_date date
    game_type string
    game_year int
    at_bat_number int
    pitch_number int
    inning int
    inning_topbot string
    pitcher long
    batter long
    player_name string
    p_throws string
    stand string
    pitch_type string
    pitch_name string
    release_speed double
    release_spin_rate double
    spin_axis double
    release_extension double
    release_pos_x double
    release_pos_z double
    pfx_x double
    pfx_z double
    plate_x double
    plate_z double
    sz_top double
    sz_bot double
    zone int
    balls int
    strikes int
    outs_when_up int
    description string
    events string
    type string
    bb_type string
    launch_speed double
    launch_angle double
    estimated_woba_using_speedangle double
    woba_value double
    delta_run_exp double
"""
_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType()}
PITCHES = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (line.split() for line in _COLUMNS.strip().splitlines())])
FIELDS = PITCHES.fieldNames()
PITCH_KEY = ["game_pk", "at_bat_number", "pitch_number"]
CHRONOLOGICAL = ["game_date", *PITCH_KEY]
#: Clean reads these directly; a frame without one of them is an error.
REQUIRED = ["pitch_type", "description", "game_type", "balls", "strikes", "game_date"]

FETCH_LOG = T.StructType(
    [T.StructField("mlbam_id", T.LongType()), T.StructField("season", T.IntegerType()), T.StructField("player_type", T.StringType()), T.StructField("row_count", T.IntegerType()), T.StructField("fetched_at", T.TimestampNTZType())]
)
LOG_KEY = ["mlbam_id", "season", "player_type"]

#: Pitch codes that fold into another one.
FOLDED = {"FT": "SI", "FA": "FF", "CS": "CU", "KC": "CU", "SV": "SL", "FO": "FS"}
#: Names of the codes that are left.
NAMES = {
    "FF": "Four-Seam", "SI": "Sinker", "FC": "Cutter", "SL": "Slider", "ST": "Sweeper", "CU": "Curveball", "CH": "Changeup", "FS": "Splitter", "KN": "Knuckleball", "EP": "Eephus", "SC": "Screwball",
}
#: Codes and descriptions of pitches that are no contest.
NO_CONTEST_CODES = ["PO", "IN", "AB", "AS", "UN"]
NO_CONTEST_DESCRIPTIONS = ["intent_ball", "pitchout", "automatic_ball", "automatic_strike"]
#: Codes that count as fastballs.
FASTBALLS = ["FF", "SI", "FC"]
#: Our choice, as none is given: descriptions that count as a swing, as a miss and as a strike on the first pitch.
MISSES = ["swinging_strike", "swinging_strike_blocked", "foul_tip"]
SWINGS = [*MISSES, "foul", "hit_into_play"]
STRIKES = [*SWINGS, "called_strike"]
